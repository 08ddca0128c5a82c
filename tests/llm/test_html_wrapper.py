import random
import re
import time

import pytest

import cadenza.llm.html_wrapper as hw
from cadenza.llm.html_wrapper import align, candidates, emit, expression, extract_main, fold, frozen, infer, matches, parse, paths, plain, stream, thawed, wrappers

PAGE = (
    "<html><head><title>T</title><script>var a='</p><article>';</script></head><body><header><p>Top</p></header><nav><ul>{nav}</ul></nav>"
    '<div class="cookie-notice">We use</div><article class="post"><h1>A &amp; B</h1>{body}<aside>see</aside><div class="comments"><p>first!</p></div></article>'
    '<form><p>mail</p></form><div id="sidebar"><p>side</p></div><footer>&copy;</footer></body></html>'
)


def page(n, body):
    return PAGE.format(nav="<li><a href='/'>x</a></li>" * n, body=body)


def alone(html):
    """The text of a page whose host has no other."""
    root = parse(html)
    key, containers = candidates(root)
    wrapper = {}
    for at, b in paths(key, containers):
        if b.items:
            wrapper[at] = align(wrapper.get(at, []), plain(fold(stream(b))))
    return "\n\n".join(emit(root, None, wrapper, frozenset(), {}))


def test_alignment():
    one = lambda s: plain(fold(s.split()))
    assert fold("a p # p # p # b".split()) == ("a", ("+", ("p", "#")), "b")
    w = align(align([], one("a p # p # b")), one("a p # b c"))
    assert expression(w) == "<a> ( <p> # )+ <b> ( <c> )?"
    assert expression(align(one("a p # b"), one("a p # p # b"))) == "<a> ( <p> # )+ <b>"
    assert expression(align(one("h p"), one("p"))) == "( <h> )? <p>"
    many = align(one(" ".join(f"a{i}" for i in range(40))), one(" ".join(f"b{i}" for i in range(40))))
    assert expression(many).startswith("( ( <a0> )? ") and matches(many, ["b3", "a3", "b3"]) and not matches(many, ["c"])


def test_a_wrapper_covers_what_it_was_inferred_from():
    r = random.Random(4)
    for _ in range(1500):
        raws = [[r.choice("p h # u".split()[: r.randint(1, 4)]) for _ in range(r.randint(1, 14))] for _ in range(r.randint(1, 7))]
        parts = []
        for k in range(0, len(raws), 3):
            w = []
            for x in raws[k : k + 3]:
                w = align(w, plain(fold(x)))
            parts.append(thawed(frozen(w)))
        w = []
        for x in parts:
            w = align(w, x)
        assert all(matches(w, x) for x in raws), (w, raws)
        # against the expression as a regular expression of the library
        if len(raws) < 4:
            show = lambda x: x if not isinstance(x, tuple) else f"(?:{''.join(s + '?' for s in x[1])})+" if x[0] == "*" else f"(?:{''.join(map(show, x[1]))})+"
            rule = re.compile("".join(f"(?:{show(x)})?" if o else show(x) for x, o in w).replace("#", "_"))
            for _ in range(5):
                x = [r.choice("p h # u".split()) for _ in range(r.randint(0, 6))]
                assert matches(w, x) == (rule.fullmatch("".join(x).replace("#", "_")) is not None), (w, x)


def test_pages(spark):
    rows = [(i, "https://h.example/%d" % i, page(1 + i % 4, "".join(f"<p>t{i}  <b>x{k}</b>\n y&eacute;<br>z</p>" for k in range(1 + i % 3)))) for i in range(40)]
    rows += [(100, None, None), (101, "no url", ""), (102, "http://u:p@Solo.example:80/x", "<p>only<p>two &lt;b&gt;<div class=ad>buy</div>"), (103, "https://h.example/z", "<body><div>lost</div><nav>n</nav>"), (0, rows[0][1], rows[0][2])]
    rows += [(200 + i, f"http://d.example/{i}", f"<body><div id=top>menu {i}</div><div class=content><p>{'main text ' * 20}{i}</p></div></body>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as main", "3 as paths", "4 as value")
    got = {r.page_id: r for r in extract_main(df).collect()}
    for i in range(40):
        assert got[i].text == "\n\n".join(["A & B"] + [f"t{i} x{k} yé z" for k in range(1 + i % 3)])
    assert got[100].text == got[101].text == "" and got[100].n_chars == 0
    assert got[102].text == "only\n\ntwo <b>" and got[103].text == "lost"
    assert got[203].text == "main text " * 20 + "3"
    assert all(r.n_chars == len(r.text) for r in got.values()) and extract_main(df).count() == len(rows)
    by = {r.host: r for r in wrappers(df).collect()}
    assert by["h.example"].main == "article" and by["h.example"].pages == 42 and "<h1> ( <p> )+" in by["h.example"].expression and "solo.example" in by
    assert extract_main(df.limit(0)).count() == 0


def test_joined_wrappers(spark, monkeypatch):
    rows = [(i, f"https://h{i % 5}.example/{i}", page(2, f"<p>t{i}</p>" * (1 + i % 3))) for i in range(60)] + [(99, None, None), (98, "http://none/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, extract_main(df).collect()), key=lambda r: r[0])
    monkeypatch.setattr(hw, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, extract_main(df).collect()), key=lambda r: r[0]) == want


def test_against_brute_force(spark):
    """Random pages of three parts, whose main text is known because it was written there."""
    r = random.Random(9)
    noise = ["<nav><a>m{}</a></nav>", "<div class='ad-box'>b{}</div>", "<aside><p>s{}</aside>", "<div class='social share'>f{}</div>", "<form><input>q{}</form>", "<section id=comments><article class=comment><p>c{}</article></section>"]
    rows, want = [], {}
    for i in range(150):
        parts, texts = [], []
        for k in range(r.randint(0, 7)):
            kind = r.choice(["p", "h2", "ul", "div", "quote", "noise", "inline"])
            t = f"text {i} {k}"
            if kind == "ul":
                n = r.randint(1, 3)
                parts.append("<ul>" + "".join(f"<li>{t} {j}" for j in range(n)) + "</ul>")
                texts += [f"{t} {j}" for j in range(n)]
            elif kind == "noise":
                parts.append(r.choice(noise).format(k))
            elif kind == "inline":
                parts.append(f"<p>{t} <span class=advert>BUY</span><i>x</i></p>")
                texts.append(f"{t} x")
            elif kind == "quote":
                parts.append(f"<blockquote><p>{t}</p><p>{t} again</p></blockquote>")
                texts += [t, f"{t} again"]
            else:
                parts.append(f"<{kind}>{t}</{kind}>")
                texts.append(t)
        tag = r.choice(["article", "main"])
        rows.append((i, f"http://h{i % 4}.example/{i}", f"<body class='has-sidebar'>{r.choice(noise).format(i)}<{tag} class='post no-comments'>{''.join(parts)}</{tag}>{r.choice(noise).format(i)}<footer>f</footer>"))
        want[i] = "\n\n".join(texts)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in extract_main(df).collect()}
    assert got == want


def test_without_alignment_text_is_lost(spark):
    rows = [(i, "https://h.example/%d" % i, page(1, "<p>t</p>" * (1 + i % 3) + "<h2>x</h2>" * (i % 2))) for i in range(12)]
    roots = [parse(h) for _, _, h in rows]
    whole, first = {}, {}
    for root in roots:
        for at, b in paths(*candidates(root)):
            if b.items:
                x = plain(fold(stream(b)))
                whole[at] = align(whole.get(at, []), x)
                first.setdefault(at, x)
    full = [emit(root, "article", whole, frozenset(), {}) for root in roots]
    assert all(len(t) == 2 + i % 3 + i % 2 for i, t in enumerate(full))
    assert sum(map(len, full)) > sum(len(emit(root, "article", first, frozenset(), {})) for root in roots)
    assert emit(roots[0], "article", {}, frozenset(), {}) == []


def test_template_is_no_slot(spark):
    """In a container without a name, what all pages say is template."""
    body = "<body><div class=intro>Welcome to us</div><div class=x><p>{0} a</p><p>{0} b</p></div><div class=y><p>{0} c</p></div><div class=z>All rights</div></body>"
    rows = [(i, f"http://t.example/{i}", body.format(f"page {i}")) for i in range(6)] + [(10, "http://two.example/1", body.format("only")), (11, "http://two.example/2", body.format("two"))]
    rows += [(20 + i, f"http://copies.example/{i}", body.format("same")) for i in range(9)]
    got = {r.page_id: r.text for r in extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "page 3 a\n\npage 3 b\n\npage 3 c"
    assert got[10] == "Welcome to us\n\nonly a\n\nonly b\n\nonly c\n\nAll rights" and got[20] == got[10].replace("only", "same")


@pytest.mark.parametrize("head", ['<main class="content has-sidebar">', '<article class="post no-comments">', '<main class="page with-nav">', '<article><div class="elementor-widget-text-editor elementor-widget">', "<body class='has-sidebar'>", '<div id=main class="social-science">'])
def test_compound_names_are_no_noise(head):
    assert alone(f"{head}<p>kept</p>") == "kept"


def test_noise():
    assert alone("<article><p>a</p><span class='advert'>BUY</span><p class=ad>x<p>b</p><div class='post-comments'>c</div><ul class=nav-links><li>l</ul><div role=navigation>n</div>d</article>") == "a\n\nb\n\nd"
    assert alone("<header>H</header><main><header>kept</header><p>x</main>") == "kept\n\nx"
    assert alone("<p>a<img src=x>b<hr>c<!-- no --><![CDATA[no]]><?php no ?>d<br/>e") == "ab\n\nc d e".replace("c d", "cd")
    assert alone("<head><title>t</title><body><p>x</body>") == "x" and alone("1 < 2 <3 & &lt;4&gt; <") == "1 < 2 <3 & <4> <"
    assert alone("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e<p>f<dd>g</dl>") == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng"
    assert alone("<p title='open>a</p><p>b</p>") == "a\n\nb" and alone("<p>a<b") == "a<b"


@pytest.mark.parametrize(
    "html", ["<a " * 200_000, '<a "' * 200_000, "<div>" * 60_000 + "x", "<div>x" * 60_000, "<div>" * 50_000 + "</b></p></span>" * 50_000, "<" * 500_000, "<!--" * 200_000, "<li>x" * 60_000, "<span class=ad>" * 50_000 + "</span>" * 50_000, '<p class="' + "x " * 300_000 + '">t']
)
def test_broken_pages_in_linear_time(html):
    start = time.process_time()
    alone(html)
    assert time.process_time() - start < 25


def test_many_streams_of_a_path(spark):
    """More streams than are folded at once, and a host of many templates."""
    r = random.Random(2)
    rows = [("h", "p", __import__("json").dumps(fold([r.choice(["a", "b", "c", "#"]) for _ in range(r.randint(1, 9))]))) for _ in range(300)]
    got = infer(spark.createDataFrame(sorted(set(rows)), "host string, path string, value string")).collect()
    assert len(got) == 1
    many = lambda i: "".join(f"<table class=k{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}><tr><td>x</table>" for k in range(120))
    pages = [(200 + i, f"http://m.example/{i}", f"<body>{many(i)}</body>") for i in range(24)]
    pages += [(300 + i, f"http://m.example/t{i}", f"<body><section id=q{chr(97 + i)}>top</section><main><p>{'text ' * 400}</p></main></body>") for i in range(24)]
    got = {x.page_id: x.text for x in extract_main(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[200 + i] == "\n\n".join(["x"] * 120) and got[300 + i] == ("text " * 400).strip() for i in range(24))


def test_pages_within_a_form(spark):
    """A form around a page is no form; one that asks for input goes, also within an article."""
    text = "main text " * 30
    rows = [
        (0, "http://f.example/0", "<body><form id=f><main><p>main text 0</p></main></form></body>"),
        (1, "http://g.example/1", f"<body><form action=/><nav>m</nav><div><p>{text}</p><p>end</p></div><input type=hidden></form></body>"),
        (2, "http://h.example/2", "<body><article><p>one</p><form><label>mail</label><input><button>go</button><p>We never share it.</p></form><p>two</p></article></body>"),
        (3, "http://i.example/3", f"<body><form><p>{text}</p>"),
        (4, "http://j.example/4", "<body><div><form><p>find</p><input></form></div><p>rest"),
        (5, "http://k.example/5", "<body><article><form><select></select></form>kept</article>"),
    ]
    got = {r.page_id: r.text for r in extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "main text 0", 1: text.strip() + "\n\nend", 2: "one\n\ntwo", 3: text.strip(), 4: "rest", 5: "kept"}
