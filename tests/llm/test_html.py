import html
import random

from flowledger.llm import html_extract as h


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def page(rng, kind):
    body = [words(rng, rng.randint(8, 40)) + " a &amp; b &lt;" for _ in range(rng.randint(1, 6))]
    title = words(rng, 5)
    want = "\n".join([title, *(html.unescape(x) for x in body)])
    ps = "".join(f"<p>{x}</p>" if rng.random() < 0.7 else f"<p><b>{x}<br>" for x in body)
    nav = "<nav><ul>" + "".join(f"<li><a href='/x'>{words(rng, 1)}</a></li>" for _ in range(rng.randint(1, 5))) + "</ul></nav>"
    extra = f"<div class='cookie-notice'>{words(rng, 9)}</div>" if rng.random() < 0.5 else ""
    comments = f"<div id='comments'><p>{words(rng, 30)}</p></div>" if rng.random() < 0.5 else ""
    head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p><article>';</script></head><body>"
    if kind == "article":
        main = f"<article><h1>{title}</h1>{ps}<aside><p>{words(rng, 20)}</p></aside></article>"
    else:
        main = f"<div class='wrap'><div class='text'><h1>{title}</h1>{ps}</div></div>"
    return f"{head}<header>{words(rng, 4)}</header>{nav}<!-- x --><div class=ad>{words(rng, 12)}</div>{extra}{main}<form><input name=q>{words(rng, 3)}</form>{comments}<footer>&copy; {words(rng, 5)}</footer>" + ("</body></html>" if rng.random() < 0.8 else ""), want


def test_templates(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(200):
        text, w = page(rng, "article" if i % 2 else "div")
        rows.append((i, f"https://{'abc'[i % 2]}.example.com/{i}", text, "x"))
        want[i] = w
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = h.main_text(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in h.main_text(df).collect()}
    for r in df.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        for tag in ("h1", "p"):
            inner = inner.replace(f"<{tag}>", "\n").replace(f"</{tag}>", "\n")
        inner = inner.replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        assert got[r["page_id"]] == "\n".join(" ".join(html.unescape(x).split()) for x in inner.split("\n") if x.strip())


def test_wrapper_expression():
    a = h.fold(h.parse("<body><div>Hello</div><ul><li>x</li><li>y</li></ul></body>"))
    b = h.fold(h.parse("<body><div>World</div><p>more</p><ul><li>z</li></ul></body>"))
    assert h.expression(h.merge(a, b)) == "<> <body> <div> #PCDATA </div> (<p> \"more\" </p>)? <ul> (<li> #PCDATA </li>)+ </ul> </body> </>"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://x.org", "plain text"), (3, "http://x.org", "<p>one<p>two"), (4, "not a url", "<div" * 50), (5, "http://x.org", "<article>&nbsp; </article>"), (6, "http://u@x.org:80/", "<p>a" + " b" * 50000), (6, "http://u@x.org:80/", "<p>a" + " b" * 50000), (7, "x", "<script>never closed"), (8, "x", '<a href="broken>text')]
    got = h.main_text(spark.createDataFrame([(*r, 1, "y") for r in rows], "page_id long, url string, html string, host int, wrapper string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[7] == "" and by[None] == "plain text" and by[3] == "one\ntwo" and len(by[6]) == 100001
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def bare(rng, host):
    """(page, its article's text) on a host without telling elements or names: the template's texts are the host's own."""
    body = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(3, 6))]
    lead, own = words(rng, 60), f"All about {host} since the beginning"
    left = "".join(f"<div class=q7><a href=/{k}>{words(rng, 2)}</a></div>" for k in range(rng.randint(3, 6)))
    ask = f"<div class=k3><div>Readers of {host} like to know more of this each week</div></div>" if rng.random() < 0.5 else ""
    inner = "".join(f"<p>{x}</p>" for x in body[:2]) + f"<div class=h8>Please tell your friends of {host} now</div>" + "".join(f"<p>{x}</p>" for x in body[2:])
    page = f"<html><body><div class=z1>{own}</div><div class=y2>{left}</div><div class=x4><div class=w5><p>{lead}</p></div><div class=v6><h1>{body[0][:20]}</h1>{inner}</div></div>{ask}<div class=t9>{words(rng, 3)}</div></body></html>"
    return page, "\n".join([lead, " ".join(body[0][:20].split()), *body])


def test_hosts_without_telling_names(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(80):
        host = f"{'ab'[i % 2]}.example.net"
        text, want[i] = bare(rng, host)
        rows.append((i, f"https://{host}/{i}", text))
    got = {r["page_id"]: r["text"] for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    alone = {i: h.extract(text, None) for i, _, text in rows}  # what the wrapper is for
    assert sum(alone[i] != want[i] for i in want) > 0.9 * len(want)


def test_vague_names_in_an_article_are_no_reason():
    inner = "".join(f"<{t}><p>{words(random.Random(k), 12)}</p></{t.split()[0]}>" for k, t in enumerate(["div class='promotion-history'", "div class='social-science'", "div class='related-work'", "section id='notice'", "div class='share'"]))
    page = f"<body><nav>x y</nav><article><h1>Title</h1>{inner}<div class='ad'>buy this</div><div id=comments><p>nice</p></div></article></body>"
    for wrapper in (None, h.Wrapper(h.flat(h.infer([h.parse(page)])))):
        assert h.extract(page, wrapper).split("\n") == ["Title", *(words(random.Random(k), 12) for k in range(5))]


def test_article_text_that_copies_share_is_no_template():
    rng = random.Random(6)
    body = [words(rng, 30) for _ in range(8)]
    pages = [f"<body><article><h1>T</h1>{''.join(f'<p>{x}</p>' for x in body)}<p>copy {k} {words(rng, 4)}</p></article></body>" for k in range(12)]
    wrapper = h.Wrapper(h.flat(h.infer([h.parse(x) for x in pages])))
    assert all(h.extract(x, wrapper).split("\n")[1:9] == body for x in pages)


def test_deep_and_wide_pages():
    deep = "<body>" + "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000
    assert h.extract(deep, None) == "deep text" and h.extract(deep, h.Wrapper(h.flat(h.infer([h.parse(deep), h.parse(deep)])))) == "deep text"
    wide = [h.parse("<body><main>" + "".join(f"<div class='{'abcdefghij'[i % 10]}{'klmnopqr'[i * 7 % 8]}'>row {i} of {k}</div>" for i in range(k, 1500 + k)) + "</main>") for k in (0, 7)]
    assert h.Wrapper(h.flat(h.infer(wide))).read(h.parse("<body><main><div class=ak>row 3 of 9</div><div class=zz>new</div></main>"))[0] == ["row 3 of 9", "new"]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for table in (1 << 22, 30):
        h.TABLE, was = table, h.TABLE
        for _ in range(60):
            x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, a in enumerate(x):
                for j, b in enumerate(y):
                    best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
            got = h.common(x, y)
            assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        h.TABLE = was


def read(pages):
    """Texts of the pages of one host, by the wrapper of them all."""
    w = h.Wrapper(h.flat(h.infer([h.parse(p) for p in pages])))
    return [h.extract(p, w) for p in pages]


def prose(k, n=60):
    return " ".join(f"word{k}x{i}" for i in range(n))


def test_labels_that_pages_share_stay_in_the_article():
    pages = [f"<html><body><nav><a href=/>Home</a></nav><article><h1>Film {k}</h1><dl><dt>Director</dt><dd>Name{k} Surname{k}</dd></dl><p>{prose(k)}</p><p>Serve it cold and enjoy.</p></article></body></html>" for k in range(6)]
    for k, text in enumerate(read(pages)):
        assert text == f"Film {k}\nDirector\nName{k} Surname{k}\n{prose(k)}\nServe it cold and enjoy."


def test_shared_links_and_named_notices_go():
    pages = [f"<body><article><p>{prose(k)}</p><div class=more><a href=/x>Read more stories here</a></div><div class=notice><p>We use cookies on this page.</p></div></article></body>" for k in range(6)]
    assert read(pages) == [prose(k) for k in range(6)]


def test_a_short_lead_beside_a_long_body():
    pages = [f"<body><div id=top><a href=/>Home</a></div><div class=page><p>Lead number {k} of a few words only.</p><div class=body><p>{prose(k, 150)}</p></div></div></body>" for k in range(5)]
    want = [f"Lead number {k} of a few words only.\n{prose(k, 150)}" for k in range(5)]
    assert read(pages) == want
    assert [h.extract(p, None) for p in pages] == want


def test_names_alone_drop_no_article_text():
    page = f"<body><article><p>{prose(1)}</p><section class=menu><p>The menu: soup and fish.</p></section><ul class=navigation><li>Take the ferry.</li></ul><p>An <span class=ad>advert</span> is a text.</p></article></body>"
    assert h.extract(page, None) == f"{prose(1)}\nThe menu: soup and fish.\nTake the ferry.\nAn advert is a text."
    links = f"<body><article><p>{prose(2)}</p><ul class=menu><li><a href=a>One page</a></li><li><a href=b>Other page</a></li></ul></article></body>"
    assert h.extract(links, None) == prose(2)


def test_math_is_inline():
    page = f"<body><article><p>{prose(3)}</p><p>the sum <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation encoding=tex>x+1</annotation></math> is known</p></article></body>"
    assert h.extract(page, None) == f"{prose(3)}\nthe sum x+1 is known"
