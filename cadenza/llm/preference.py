"""Preference formatting of chosen and rejected conversations.

The turns of a pair are compared position by position; the longest common prefix
is rendered once as the prompt, what follows on either side as that side's
completion, with a mask of the spans that count for the loss (the text and end
mark of the completing role's turns). One shuffle brings the turns of a pair together,
everything else is higher-order functions on the turn arrays. A pair becomes one
output row, so it is its conversations, not the corpus, that must fit in a row.

Defined results: turns are ordered by turn, role and text, a null turn first;
null role and null text count as empty; repeated rows are turns of their own; a
null id is an id; a side without turns has an empty completion, and if one side is
a prefix of the other its completion is empty; marker text inside a turn or a role is
broken by a space so that it can't close or open a turn; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE = "assistant"


def _role(x: Column) -> Column:
    """A role without marks: those in it are broken by a space."""
    return F.replace(F.replace(x.role, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _turn(x: Column) -> Column:
    return F.concat(F.lit("<|"), _role(x), F.lit("|>\n"), F.replace(x.text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def _mask(turns: Column, role: str) -> Column:
    """(start, end) code points of what counts in the rendered turns."""
    state = F.aggregate(
        turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a.at + F.char_length(_turn(x))).alias("at"),
            F.when(x.role == role, F.concat(a.spans, F.array(F.struct((a.at + F.char_length(_role(x)) + 5).alias("start"), (a.at + F.char_length(_turn(x)) - 1).alias("end")))))
            .otherwise(a.spans).alias("spans"),
        ),
    )
    return state.getField("spans")


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", role: str = ROLE) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) from rows (pair, side, turn, role, text).

    ``side`` is ``chosen`` or ``rejected``; a pair without a chosen row gives no result.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, row)))
    both = turns.groupBy(F.col(pair_col).alias("pair_id")).agg(side("chosen").alias("c"), side("rejected").alias("r")).filter(F.size("c") > 0)
    differs = F.filter(
        F.sequence(F.lit(0), F.least(F.size("c"), F.size("r"))),
        lambda i: (i >= F.size("c")) | (i >= F.size("r")) | (F.get("c", i).role != F.get("r", i).role) | (F.get("c", i).text != F.get("r", i).text),
    )
    both = both.withColumn("n", F.get(differs, F.lit(0)))
    text = lambda a: F.array_join(F.transform(a, _turn), "")
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("prompt_turns"), text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"),
        _mask(F.col("c"), role).alias("chosen_mask"), _mask(F.col("r"), role).alias("rejected_mask"),
    )


def crossed_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: rejected leaves its conversation after 1 to 3 turns for the turns of the one with the next lower id."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    keep = lambda c: F.conv(F.substring(F.md5(c.cast("string")), 1, 6), 16, 10).cast("long") % 3 + 1
    own = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    start = turns.filter(F.col("turn") < keep(F.col("conv_id"))).select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    other = turns.withColumn("pair_id", F.col("conv_id") + 1).filter(F.col("turn") >= keep(F.col("pair_id"))).select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    return own.unionByName(start).unionByName(other)


def query(spark, sf_dir):
    from .common import table

    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x.start, F.lit("-"), x.end)), ",")
    out = format_preferences(crossed_pairs(table(spark, sf_dir, "conversations")))
    return out.withColumnRenamed("pair_id", "conv_id").withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
k as (select distinct conv_id, ('0x' || substr(md5(conv_id::varchar), 1, 6))::bigint % 3 + 1 as keep from (select conv_id from t union select conv_id + 1 from t)),
rows_ as (
  select conv_id as pair_id, 'chosen' as side, turn, role, text from t
  union all select t.conv_id, 'rejected', turn, role, text from t join k on t.conv_id = k.conv_id where turn < keep
  union all select k.conv_id, 'rejected', turn, role, text from t join k on t.conv_id + 1 = k.conv_id where turn >= keep
), p as (
  select *, row_number() over (partition by pair_id, side order by turn, role, text) as pos,
    '<|' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) as shown from rows_ where pair_id in (select conv_id from t)
), d as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, min(case when a.pos is null or b.pos is null or a.role <> b.role or a.text <> b.text then coalesce(a.pos, b.pos) end) as first_, max(coalesce(a.pos, b.pos)) as last_
  from (select * from p where side = 'chosen') a full join (select * from p where side = 'rejected') b on a.pair_id = b.pair_id and a.pos = b.pos group by 1
), n as (select pair_id, coalesce(first_ - 1, last_) as n from d
), e as (
  select p.*, n.n, coalesce(sum(length(shown)) over (partition by p.pair_id, side, pos > n order by pos rows between unbounded preceding and 1 preceding), 0) as at_ from p join n on p.pair_id = n.pair_id
)
select pair_id as conv_id, any_value(n) as prompt_turns,
  coalesce(string_agg(shown, '' order by pos) filter (where side = 'chosen' and pos <= n), '') as prompt,
  coalesce(string_agg(shown, '' order by pos) filter (where side = 'chosen' and pos > n), '') as chosen,
  coalesce(string_agg(shown, '' order by pos) filter (where side = 'rejected' and pos > n), '') as rejected,
  coalesce(string_agg((at_ + 14) || '-' || (at_ + length(shown) - 1), ',' order by pos) filter (where side = 'chosen' and pos > n and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg((at_ + 14) || '-' || (at_ + length(shown) - 1), ',' order by pos) filter (where side = 'rejected' and pos > n and role = 'assistant'), '') as rejected_mask
from e group by pair_id
"""
