"""Main text of pages: markup, and what the pages of a host repeat, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from criterium.llm import html

PAGES = "page_id long, url string, html string"


def texts(page):
    return [t for _, t in html.blocks_of(page)]


def test_article_is_kept_and_furniture_goes():
    page = (
        '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div><header>Site</header>'
        "<article><h1>A &amp; B</h1><p><b>First  line<br>more\n<p>Second &lt;x&gt; 1 < 2</p><aside>Side</aside><div id='comments'>Troll</div><form>f</form></article><footer>&copy;</footer>"
    )
    assert texts(page) == ["A & B", "First line more", "Second <x> 1 < 2"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # class names that only contain a name of furniture
        ('<div class="layout no-sidebar"><article><p>x</p></article></div>', ["x"]),
        ('<div class="side-by-side"><article><p class="related-work">x</p></article></div>', ["x"]),
        ('<div class="has-sidebar"><article class="social-science"><p>x</p></article></div>', ["x"]),
        ('<div class="ads">a</div><div class="ad-slot-1">b</div><div id="cookieNotice">c</div><div class="acme-sidebar">d</div><p>t', ["t"]),
        ('<div class="sidebar"><article>t</article></div>', ["t"]),
        # end tags that may be left out
        ('<article><p class="promo">ad<p>Real text<p>More</article>', ["Real text", "More"]),
        ('<article><ul><li class="share">s<li>real item</ul><p>rest</article>', ["real item", "rest"]),
        ('<article><ul><li>a<ul><li class="menu">b<li>c</ul><li>d</ul></article>', ["a", "c", "d"]),
        ('<article><table><tr><td class="sidebar">s<td>cell</table><p>rest</article>', ["cell", "rest"]),
        ('<article><dl><dt>a<dd class="ad">b<dt>c<dd>d</dl></article>', ["a", "c", "d"]),
        ("<head><title>T</title><p>text", ["text"]),
        # unclosed elements end with their parent
        ("<div><article><form>f<p>g</article><article>next</article></div>", ["next"]),
        ("<article><p>a</p></p><p>b</span></article>", ["a", "b"]),
        ("<nav>only", []),
        # reader comments
        ('<article>A<article class="comment">troll</article></article><article class="comment">troll</article>', ["A"]),
        ('<article><div class="comments"><p>a<p>b</div><p>c</article>', ["c"]),
        ('<article><header><h1>A</h1></header><p>B <span class="ad">buy <span>now</span></span> C</p><footer>f</article>', ["A", "B C"]),
        ("a < b <p>x", ["a < b", "x"]),
    ],
)
def test_markup(page, want):
    assert texts(page) == want


def extracted(spark, rows, parts=None):
    df = spark.createDataFrame(rows, PAGES)
    return {r["page_id"]: r["text"] for r in html.extract(df.repartition(parts) if parts else df).collect()}


def brute(rows):
    """Counts of all runs of eight words over the distinct pages of a host, and what is left without frequent ones."""
    out, hosts = {}, {}
    for k, url, page in rows:
        hosts.setdefault(url.split("/")[2].lower(), {}).setdefault(page, []).append(k)
    for pages in hosts.values():
        words = {p: [t.split(" ") for t in texts(p)] for p in pages}
        flat = {p: [w for b in bs for w in b] for p, bs in words.items()}
        counts = Counter(r for p in pages for r in {tuple(flat[p][i : i + 8]) for i in range(len(flat[p]) - 7)})
        for p, ids in pages.items():
            content = "<article" in p
            least = max(10, 0.8 * len(pages)) if content else max(3, 0.5 * len(pages))
            gone = [any(counts[tuple(flat[p][j : j + 8])] >= least for j in range(max(0, i - 7), min(i, len(flat[p]) - 8) + 1)) for i in range(len(flat[p]))]
            kept, at = [], 0
            for b in words[p]:
                here = gone[at : at + len(b)]
                if content:
                    here = [all(here)] * len(b)
                    gone[at : at + len(b)] = here
                at += len(b)
                kept.append(" ".join(w for w, g in zip(b, here) if not g))
            text = "\n\n".join(t for t in texts(p)) if (sum(gone) > 0.8 * len(gone) if content else len(gone) - sum(gone) < 8) else "\n\n".join(t for t in kept if t)
            out.update((k, text) for k in ids)
    return out


def site(rng, host, n, article):
    """Pages with a banner, a list of short items and an imprint that most of them repeat, passages that few share, and near copies."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    say = lambda k: " ".join(word() for _ in range(k))
    banner, imprint, passage, menu = say(9), say(30), say(60), [say(2) for _ in range(8)]
    tag, rows, before = ("article" if article else "div"), [], ""
    for k in range(n):
        own = say(rng.randint(100, 200))
        parts = [f"<p>{banner}</p>"] * (rng.random() < 0.9) + [f"<ul><li>{'<li>'.join(menu)}</ul>", f"<p>{own}</p>"]
        parts += [f"<p>{passage}</p>"] * (rng.random() < 0.2) + [f"<p>{say(5)} {imprint} {say(3)}</p>"]
        page = f"<body><{tag}>{''.join(parts)}</{tag}>"
        if k % 9 == 8:
            page = before.replace("</body>", "") + f"<p>{word()}"
        if k % 7 == 6:
            page = before
        before = page
        rows.append((f"http://{host}/{k}", page))
    return rows


def test_repeated_runs_equal_brute_force_for_any_partitions(spark):
    rng = random.Random(3)
    pages = [*site(rng, "open.example", 60, False), *site(rng, "content.example", 40, True), *site(rng, "two.example", 2, False), *site(rng, "three.example", 3, False)]
    rng.shuffle(pages)
    rows = [(k, url, page) for k, (url, page) in enumerate(pages)]
    want = brute(rows)
    assert sum(len(t) for t in want.values()) < 0.9 * sum(len("\n\n".join(texts(p))) for *_, p in rows)
    assert extracted(spark, rows) == want
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert extracted(spark, rows, 100) == want == extracted(spark, rows, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_near_copies_and_passages_stay(spark):
    rng = random.Random(2)
    body = [" ".join(str(rng.random()) for _ in range(30)) for _ in range(5)]
    rows = [(k, "http://h/x", f"<div>{'</div><div>'.join(body)}</div><p>edit {k}") for k in range(12)]
    rows += [(20 + k, "http://g/x", f"<article><p>own {k}</p><p>{body[0] if k < 8 else k}</p></article>") for k in range(20)]
    got = extracted(spark, rows)
    assert all(got[k] == "\n\n".join([*body, f"edit {k}"]) for k in range(12)) and got[20] == f"own 0\n\n{body[0]}"


def test_short_articles_on_heavy_pages_are_cleaned(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("aeioubdlmnrst") for _ in range(6)) for _ in range(n))
    heavy, own = say(120), [say(60 if k % 2 else 10) for k in range(8)]
    got = extracted(spark, [(k, f"http://heavy/{k}", f"<div>{heavy}</div><div>{o}</div>") for k, o in enumerate(own)])
    assert got == dict(enumerate(own))


def test_anchors_meet_in_repeated_substrings():
    rng = np.random.default_rng(1)
    same = rng.integers(0, 2**63, html.WINDOW, dtype=np.uint64)
    found = []
    for k in range(50):
        runs = np.concatenate([rng.integers(0, 2**63, k, dtype=np.uint64), same, rng.integers(0, 2**63, 60 - k, dtype=np.uint64)])
        at = html.anchors_of(runs, np.array([0, len(runs) + html.RUN - 1]))
        found.append({int(r) for r in runs[at]} & {int(r) for r in same})
    assert all(int(same.min()) in f for f in found)


def test_pages_odd(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "http://h/y", "<p>text</p>"), (3, "http://h/y", "<p>text</p>"), (None, "bad url", "plain"), (4, "http://h/z", "<nav>only"), (5, "http://h/w", "<p>" + "long word " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{PAGES}, text string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html.extract(df).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "text", 4), ("3", "text", 4), ("4", "", 0), ("5", ("long word " * 50_000).strip(), 499_999), ("None", "plain", 5)]
    assert html.extract(df.limit(0)).count() == 0
