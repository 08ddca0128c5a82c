"""Effect chains: splitting into fragments and edges, positions, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import scalars as L
from cadenza.sources.shared import cut

from .graph import levels
from .settings import resolve_style


def chain_position(df: DataFrame, keys, order: str, out: str = "position") -> DataFrame:
    """SINGLE, FIRST, LAST or OTHER within the ordered group."""
    w = W.partitionBy(*keys)
    n, rn = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    return df.withColumn(out, F.when(n == 1, "SINGLE").when(rn == 1, "FIRST").when(rn == n, "LAST").otherwise("OTHER"))


def split_chain(effects: DataFrame, key: str = "voice") -> DataFrame:
    """(key, chain, fragment, tokens, sources, targets): chains end at ``;``, fragments at `` tee ``.

    Tokens ``X->`` name sources and ``->X`` targets; both leave the token list.
    """
    chain = effects.select(key, F.posexplode(F.split("effects", ";")).alias("chain", "_c"))
    frag = chain.select(key, "chain", F.posexplode(F.split(F.trim("_c"), " tee ")).alias("fragment", "_f"))
    frag = frag.withColumn("_t", L.tokenize(F.trim("_f")))
    source, target = (lambda t: t.rlike(r"^[^>]+->$")), (lambda t: t.rlike(r"^->.+$"))
    return frag.select(
        key, "chain", "fragment", F.filter("_t", lambda t: ~source(t) & ~target(t)).alias("tokens"),
        F.transform(F.filter("_t", source), lambda t: F.regexp_replace(t, "->$", "")).alias("sources"), F.transform(F.filter("_t", target), lambda t: F.regexp_replace(t, "^->", "")).alias("targets"),
    )


def check_chains(fragments: DataFrame, key: str = "voice") -> DataFrame:
    """(key, chain, fragment, problem): one row per broken rule.

    A fragment has at most one target; the last chain has none; only the first fragment of a
    chain has sources and only the last a target; a source must be a target of an earlier chain.
    """
    got = chain_position(fragments, [key, "chain"], "fragment", "_fp")
    chains = chain_position(fragments.select(key, "chain").distinct(), [key], "chain", "_cp")
    got = got.join(chains, [key, "chain"])
    ns, nt = F.size("sources"), F.size("targets")
    rule = lambda bad, name: F.when(bad, F.lit(name))
    broken = F.filter(F.array(
        rule(nt > 1, "several targets"), rule((nt > 0) & F.col("_cp").isin("LAST", "SINGLE"), "target in last chain"),
        rule((ns > 0) & ~F.col("_fp").isin("FIRST", "SINGLE"), "source after first fragment"), rule((nt > 0) & ~F.col("_fp").isin("LAST", "SINGLE"), "target before last fragment"),
    ), lambda x: x.isNotNull())
    local = got.select(key, "chain", "fragment", F.explode(broken).alias("problem"))
    made = fragments.select(key, F.explode("targets").alias("name"), F.col("chain").alias("_made")).groupBy(key, "name").agg(F.min("_made").alias("_made"))
    used = fragments.select(key, "chain", "fragment", F.explode("sources").alias("name")).join(made, [key, "name"], "left")
    lost = used.filter(F.col("_made").isNull() | (F.col("_made") >= F.col("chain"))).select(key, "chain", "fragment", F.lit("unknown source").alias("problem")).distinct()
    return local.unionByName(lost)


def fragment_levels(fragments: DataFrame, key: str = "voice") -> DataFrame:
    """Add ``level``: the step at which a fragment can run, 0 first; null on a cycle or behind one.

    A fragment follows the one before it in its chain and all that make the sources it names.
    """
    node = F.struct("chain", "fragment")
    named = fragments.select(key, node.alias("node"), "sources", "targets")
    made = named.select(key, F.col("node").alias("a"), F.explode("targets").alias("_name"))
    used = named.select(key, F.col("node").alias("b"), F.explode("sources").alias("_name"))
    before = F.struct("chain", (F.col("fragment") - 1).alias("fragment"))
    edges = made.join(used, [key, "_name"]).select(key, "a", "b").unionByName(fragments.filter("fragment > 0").select(key, before.alias("a"), node.alias("b")))
    got = levels(named, edges, [key]).select(key, F.col("node.chain").alias("chain"), F.col("node.fragment").alias("fragment"), "level")
    return fragments.join(got, [key, "chain", "fragment"])


def chain_plan(voices: DataFrame, effects: DataFrame) -> DataFrame:
    """(voice, chain, fragment, tokens, sources, targets, position, level, problems): which steps feed which, per voice, and in which order they can run."""
    frag = cut(split_chain(resolve_style(voices, effects).select("voice", "effects")))
    levelled = fragment_levels(frag)
    ring = levelled.filter("level is null").select("voice", "chain", "fragment", F.lit("cycle").alias("problem"))
    bad = check_chains(frag).unionByName(ring).groupBy("voice", "chain", "fragment").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    return chain_position(levelled, ["voice", "chain"], "fragment").join(bad, ["voice", "chain", "fragment"], "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
