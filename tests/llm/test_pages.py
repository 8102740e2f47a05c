import random

from os.path import commonprefix

from glyphloom.llm.pages import extract, shared_lines

SCHEMA = "page_id long, url string, html string, text string, host string, n_chars int"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
        shared = sorted(shared_lines(a, b))
        assert len(shared) == lcs(a, b), (a, b)
        left = iter(b)
        assert all(a[k] in left for k in shared)


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_extraction(spark):
    top, end = "<div>Site of things</div><nav><a href=/>Home</a></nav>", "<div>All rights</div><footer>c</footer>"
    rows = [
        (1, "http://a.org/x/1", page(f"{top}<article><h1>One &amp; two</h1><p>a\n  b<b>c</b></p><script>no()</script></article>{end}")),
        (2, "http://b.org/x/1", page(f"{top}<div>First own line</div>{end}")),
        (3, "http://b.org/x/2", page(f"{top}<div>Second own line &#233;</div>{end}")),
        (3, "http://b.org/x/2", page(f"{top}<div>Second own line &#233;</div>{end}")),
        (4, "http://c.org/only", page(f"{top}<p>Alone</p>")),
        (5, None, None), (6, "http://[bad", ""), (None, "http://d.org", page("<main><p>No number</p></main>")),
        (7, "http://e.org", page("<article><p>" + "word " * 100_000 + "</p></article>")),
        (8, "http://f.org/copy", page("<p>Same</p>")), (9, "http://f.org/copy", page("<p>Same</p>")),
    ]
    got = sorted(map(tuple, extract(spark.createDataFrame([(*r, "x", "y", 0) for r in rows], SCHEMA)).collect()), key=repr)
    texts = ["One & two\na bc", "First own line", "Second own line é", "Second own line é", "Alone", "", "", "No number", ("word " * 100_000).strip(), "Same", "Same"]
    want = [(i, u, t, len(t)) for (i, u, _), t in zip(rows, texts)]
    want[4] = (4, "http://c.org/only", "Site of things\nAlone", 20)
    assert got == sorted(want, key=repr)
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_neighbours_on_a_large_host_are_those_of_a_sorted_host(spark):
    rng = random.Random(7)
    pages = []
    for host, count in (("big.org", 6000), ("other.org", 40), ("copies.org", 300), ("alone.org", 1)):
        for i in range(count):
            section = i // 2 if host != "copies.org" else 0
            own = f"Text {i} {rng.random()}" if host != "copies.org" or i in (0, 150) else "Copy"
            pages.append((len(pages), f"http://{host}/s{section:04}/{i:05}", [f"Top of {host}", f"Menu of section {section}", own]))
    rows = [(i, u, page("".join(f"<div>{x}</div>" for x in lines))) for i, u, lines in pages]
    rng.shuffle(rows)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    hosts = {}
    for i, u, lines in pages:
        hosts.setdefault(u.split("/")[2], []).append((u.split(".org")[1], i, lines))
    for own in hosts.values():
        own.sort()
        for k, (path, i, lines) in enumerate(own):
            before = next((o for o in own[:k][::-1] if o[2] != lines), None)
            after = next((o for o in own[k + 1 :] if o[2] != lines), None)
            near = [o for o in (before, after) if o]
            other = max(near, key=lambda o: len(commonprefix([o[0], path])))[2] if near else []
            assert got[i] == "\n".join(x for x in lines if x not in other), (i, path)


def test_names_that_only_contain_a_word_of_surroundings_lose_no_article(spark):
    text = "<p>Own words {}</p>"
    bodies = [
        f'<div class="layout no-sidebar"><article>{text}</article></div>', f'<form action=/><input name=a><article>{text}</article></form>',
        f'<article class="post"><div class="entry has-share-buttons">{text}</div></article>', f'<article><div class="promotion-law">{text}</div></article>',
        f'<div class="sidebar"><main>{text}</main></div>', f'<form><h1>Title</h1>{text}<button>Go</button></form>', f'<div id="comments-page">{text}</div>'.replace("comments-page", "no-comments"),
        f'<div id="comments"><article>Other</article></div><article>{text}</article>', f'<article>{text}<div class="share-buttons">Share</div><form><input>Mail</form><aside>Side</aside></article>',
    ]
    rows = [(i, f"http://h{i}.org/a", page(b.format(i))) for i, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("Title\n" if i == 5 else "") + f"Own words {i}" for i in range(len(bodies))}


def test_the_nearest_page_decides_on_lines_of_articles(spark):
    """A shared line goes from doubtful blocks, and where the other page has it outside its article; shared text stays."""
    article = '<article><p>Text {0}</p><p>A heading of both</p><div class="entry has-share-buttons"><p>Send it on</p><p>Own {0}</p></div>{1}</article>{2}'
    rows = [
        (1, "http://a.org/x/1", page(article.format(1, "<p>House rules apply</p>", ""))),
        (2, "http://a.org/x/2", page(article.format(2, "", "<div>House rules apply</div>"))),
    ]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i}\nA heading of both\nOwn {i}" for i in (1, 2)}


def test_alignment_of_long_pages_in_parts(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr("glyphloom.llm.pages.ALIGN_BITS", 60)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))] for _ in range(2))
        shared = shared_lines(a, b)
        assert len(shared) == lcs(a, b) and all(a[i] == b[j] for i, j in shared.items())
        assert [j for _, j in sorted(shared.items())] == sorted(shared.values())
