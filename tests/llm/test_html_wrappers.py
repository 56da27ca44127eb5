from html.parser import HTMLParser

from corridora.llm import html_wrappers as hw


def page(body, head="<title>T</title><style>p{}</style><script>var t='<p>x</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def site(i):
    extra = "<blockquote>Quoted &lt;b&gt;.</blockquote>" if i % 2 else ""
    items = "".join(f"<li>item {j}</li>" for j in range(i % 3 + 1))
    return page(
        f"<header class=top><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More {i}</a></ul></nav><div class='ad'>Buy {i}!</div>"
        f"<article><h1>Title {i}</h1><p>First\n  para <b>bold</b>graph &amp; {i}<br>next<p>Second {i}{extra}<ul>{items}</ul><form><input><label>Mail</label></form>"
        f"<section class='post-comments'><p>Reader {i} says no</p></section></article><aside>Related {i}</aside><div id='cookie-notice'>Cookies</div><footer>&copy; {i}</footer>"
    )


def want(i):
    parts = [f"Title {i}", f"First para boldgraph & {i} next", f"Second {i}"] + (["Quoted <b>."] if i % 2 else []) + [f"item {j}" for j in range(i % 3 + 1)]
    return " ".join(parts)


def plain(i):
    return page(f"<div class=menu><a href=/>Home</a></div><div class=wrap><div class=body><h1>Story {i}</h1><p>{'word ' * 30}{i}</p><p>{'more ' * 20}{i}</p></div><div class=side><a href=/a>Link {i} to another</a></div></div><div>All rights reserved</div>")


SCHEMA = "page_id long, url string, html string, __host string"


def test_extraction(spark):
    rows = [(i, f"http://a.example/{i}", site(i), "x") for i in range(8)] + [(20 + i, f"HTTP://B.example/{i}", plain(i), "x") for i in range(6)]
    rows += [(40, "http://a.example/cut", site(1)[: site(1).index("Second") + 8], "x"), (50, None, None, None), (51, "not a url", "", None), (52, "http://c.example", "no markup at all", None), (53, "http://a.example/0", site(0), "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.page_id: r.text for r in hw.extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i] == want(i)
    for i in range(6):
        assert got[20 + i] == f"Story {i} " + "word " * 30 + f"{i} " + "more " * 20 + str(i)
    assert got[40] == "Title 1 First para boldgraph & 1 next Second 1" and got[50] == "" and got[51] == "" and got[52] == "no markup at all" and got[53] == want(0)


def test_mixed_templates_and_pages_without_a_host(spark):
    old = lambda i: page(f"<div id=content><div class=text><h1>Old {i}</h1><p>{'older ' * 30}{i}</p></div></div>")
    rows = [(i, f"http://a.example/{i}", site(i), None) for i in range(6)] + [(10 + i, f"http://a.example/old{i}", old(i), None) for i in range(2)]
    rows += [(20, "http://d.example/0", site(0).replace("<body>", "<body class='has-sidebar'>"), None), (30, None, site(0), None), (31, "odd", old(5), None)]
    got = {r.page_id: r.text for r in hw.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    said = lambda i: f"Old {i} " + "older " * 30 + str(i)
    assert got == {i: want(i) for i in range(6)} | {10: said(0), 11: said(1), 20: want(0), 30: want(0), 31: said(5)}


def test_empty(spark):
    assert hw.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def wrapper_of(*pages):
    w = None
    for said in pages:
        found = hw._learned(hw.parse(said)[0])
        w = hw.align(w, found) if w else found
    return w


def test_alignment_makes_options_repeats_groups_and_slots():
    w = wrapper_of("<div><h1>A</h1><p>same</p></div>", "<div><h1>B</h1><p>same</p><p>same</p><pre>x</pre></div>", "<div><p>same</p></div>")
    assert hw.expression(w) == "<div>(<h1>#</>)?(<p>'same'</>)+(<pre>'x'</>)?</>"
    # successive equal sequences become a repeated group, and a page with one of them meets it
    two = "<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"
    assert hw.expression(wrapper_of(two)) == "<dl>(<dt>#</><dd>#</>)+</>"
    assert hw.expression(wrapper_of(two, "<dl><dt>e</dt><dd>f</dd></dl>")) == "<dl>(<dt>#</><dd>#</>)+</>"
    # blocks of one name keep apart by what they hold, and by their order
    w = wrapper_of(*[f"<div>Top</div><div><h1>T{i}</h1><p>x{i}</p></div><div><ul><li>a<li>b</ul></div>" for i in range(3)])
    assert hw.expression(w) == "<div>'Top'</><div><h1>#</><p>#</></><div><ul>(<li>#</>)+</></>"


def test_contents_in_no_order_become_a_free_group():
    names = [f"x{chr(97 + i)}" for i in range(26)]
    pages = [f"<section>{''.join(f'<{n}>t</{n}>' for n in (names if k else names[::-1]))}</section>" for k in range(2)]
    w = wrapper_of(*pages)
    (section,) = w[hw.BODY]
    assert hw._is_free(section[hw.BODY]) and len(section[hw.BODY][0][hw.BODY]) == 26
    taken = []
    hw.match(hw.judge(w), hw.parse(pages[1])[0], lambda slot, runs: taken.extend(runs))
    assert sorted(taken) == list(range(26))


def test_every_text_of_a_page_fills_a_slot_of_its_wrapper():
    pages = [site(i) for i in range(8)] + [plain(i) for i in range(4)]
    template = hw.judge(wrapper_of(*pages))
    for said in pages:
        root, texts = hw.parse(said)
        taken = []
        hw.match(template, root, lambda slot, runs: taken.extend(runs))
        assert sorted(taken) == list(range(len(texts)))


def nameless(i):
    """No class says anything, no article marks the text; the wrapper's slots must tell."""
    comments = "".join(f"<div><div>user{i}{j}</div><div>{'I think so too '*(j + 1)}{i}{j}</div></div>" for j in range(i % 4))
    return page(
        f"<div class=k1><ul><li><a href=/>Start</a><li><a href=/x>Part {i}</a></ul></div><div class=k2>We use biscuits</div><div class=k3>Buy {'one' if i % 2 else 'two'} now</div>"
        f"<div class=k4><div class=k5><h1>Head {i}</h1><p>{'lorem ' * (20 + i)}{i}</p>{f'<blockquote>{i} said</blockquote>' * (i % 2)}<p>{'ipsum ' * 15}{i}</p><p>Thanks to all our readers</p></div>{comments}</div><div class=k6>Rights {i} reserved by us</div>"
    )


def test_meaningless_class_names(spark):
    df = spark.createDataFrame([(i, f"http://n.example/{i}", nameless(i), None) for i in range(24)], SCHEMA)
    got = {r.page_id: r.text for r in hw.extract(df).collect()}
    for i in range(24):
        quote = f"{i} said " * (i % 2)
        assert got[i] == f"Head {i} " + "lorem " * (20 + i) + f"{i} {quote}" + "ipsum " * 15 + f"{i} Thanks to all our readers"


class Reader(HTMLParser):
    """A plain reading of markup that has an article, by the parser of the standard library."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "div", "article", "br"}

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.held = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.flush(tag)
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.flush(tag)
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)

    def flush(self, tag):
        if tag in self.BLOCKS:
            said = " ".join("".join(self.held).split())
            self.blocks += [said] * bool(said)
            self.held = []


def test_pages_against_a_plain_reading(spark):
    from corridora.llm import queries

    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op1_html_wrappers(spark, sf).collect()
    assert len(rows) == len(html)
    for r in rows:
        reader = Reader()
        reader.feed(html[r.page_id] or "")
        assert r.text == " ".join(reader.blocks) and r.n_chars == len(r.text), r.page_id


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://c.example/same", page(f"<article><h1>One title</h1><p>{'long ' * 60}</p></article><footer>f</footer>"), None) for i in range(9)]
    rows += [(10, "http://c.example/deep", "<div>" * 400 + "deep text" + "</div>" * 400, None)]
    got = {r.page_id: r.text for r in hw.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "One title " + ("long " * 60).strip() for i in range(9)} | {10: "deep text"}


def test_articles_keep_their_own_parts(spark):
    """Sections with a word of boilerplate, recurring subheadings and trailing blocks are the article's."""
    paper = lambda i: page(
        f"<nav><a href=/>Home</a></nav><article><h1>Paper {i}</h1><p>{'method ' * 30}{i}</p><section class=discussion><h2>Discussion</h2><p>{'finding ' * 20}{i}</p></section>"
        f"<section class=related-work><h2>Related work</h2><p>{'earlier ' * 20}{i}</p></section><div class=feedback><p>Was this of use to you?</p></div>"
        f"<div class=share><h3>Share</h3><ul><li><a href=/f>Here and there</a><li><a href=/t>And elsewhere</a></ul></div></article>"
    )
    paper_text = lambda i: f"Paper {i} {'method ' * 30}{i} Discussion {'finding ' * 20}{i} Related work {'earlier ' * 20}{i}"
    recipe = lambda i: page(f"<article><h1>Dish {i}</h1><h2>{('Ingredients', 'You need')[i % 2]}</h2><p>{'flour ' * (i + 9)}{i}</p><h2>{('Method', 'Background')[i // 2 % 2]}</h2><p>Heat the oven first.</p><p>{'stir ' * 20}{i}</p></article>")
    recipe_text = lambda i: f"Dish {i} {('Ingredients', 'You need')[i % 2]} {'flour ' * (i + 9)}{i} {('Method', 'Background')[i // 2 % 2]} Heat the oven first. {'stir ' * 20}{i}"
    essay = lambda i: page(f"<article><h1>Essay {i}</h1><p>{'intro ' * 200}{i}</p>" + "".join(f"<div><p>As {j} of {i} has it</p><blockquote>{'quoted ' * 9}{i}{j}</blockquote></div>" for j in range(3)) + "</article>")
    essay_text = lambda i: f"Essay {i} {'intro ' * 200}{i} " + " ".join(f"As {j} of {i} has it {'quoted ' * 9}{i}{j}" for j in range(3))
    rows, want = [], {}
    for k, (host, make, said) in enumerate((("p", paper, paper_text), ("r", recipe, recipe_text), ("e", essay, essay_text))):
        for i in range(24):
            rows.append((100 * k + i, f"http://{host}.example/{i}", make(i), None))
            want[100 * k + i] = said(i)
    got = {r.page_id: r.text for r in hw.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_recurring_subheadings_without_an_article(spark):
    recipe = lambda i: page(f"<div class=a><a href=/>Home</a></div><div class=b><h1>Dish {i}</h1><h2>Ingredients</h2><p>{'flour ' * 30}{i}</p><h2>Method</h2><p>{'stir ' * 20}{i}</p></div><div class=c><p>All about us</p></div>")
    got = {r.page_id: r.text for r in hw.extract(spark.createDataFrame([(i, f"http://r.example/{i}", recipe(i), None) for i in range(24)], SCHEMA)).collect()}
    assert got == {i: f"Dish {i} Ingredients {'flour ' * 30}{i} Method {'stir ' * 20}{i}" for i in range(24)}


def test_comments_of_readers_fall_out(spark):
    """By a class that says so, by author and time, or by a time beside a short first slot."""
    kinds = {
        "c": lambda i, j: f"<div class=comment-item><div>reader {i}{j}</div><p>I think so {i}{j}</p></div>",
        "u": lambda i, j: f"<div><div class=user-name>reader {i}{j}</div><div class=date>long ago</div><p>I think so {i}{j}</p></div>",
        "t": lambda i, j: f"<div><div>reader {i}{j}</div><div>2024-05-0{j + 1} at 12:0{j}</div><p>I think so {i}{j}</p></div>",
    }
    rows, want = [], {}
    for k, (host, make) in enumerate(kinds.items()):
        for i in range(12):
            said = f"<article><h1>Head {i}</h1><p>{'lorem ' * 60}{i}</p><h2>Section</h2><p>{'ipsum ' * 40}{i}</p>{''.join(make(i, j) for j in range(i % 4))}</article>"
            rows.append((100 * k + i, f"http://{host}.example/{i}", page(said), None))
            want[100 * k + i] = f"Head {i} {'lorem ' * 60}{i} Section {'ipsum ' * 40}{i}"
    got = {r.page_id: r.text for r in hw.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_a_very_long_page(spark):
    body = "".join(f"<p>{'word ' * 20}{i}</p>" for i in range(30_000))
    got = hw.extract(spark.createDataFrame([(1, "http://l.example/1", page(f"<nav>menu</nav><article><h1>Long</h1>{body}</article>"), None)], SCHEMA)).first().text
    assert got == "Long " + " ".join("word " * 20 + str(i) for i in range(30_000))
