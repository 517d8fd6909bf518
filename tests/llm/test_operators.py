"""The operators against brute force, on texts with every odd case and on a test table."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import connect, same
from pyspark.sql import functions as F

from lodeframe.llm import exact_dedup, frames, graph, html_extract, language, line_dedup, mixing, ngram_join, packing, quality, queries, substring_dedup, topk, words
from lodeframe.llm.frames import stored
from lodeframe.llm.oracles import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank tonight and sing along".split()


def near(i: int) -> str:
    out = list(BASE) * 3
    out[i % len(out)] = f"changed{i}"
    return " ".join(out)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "ONE", "b"), (6, "one  two", "b"), (7, "one two", "b"), (8, " onetwo ", None),
    (9, LONG, "c"), (10, LONG + " end", "c"), (11, "é中文 ñ ü ß ΑΒΓ", "c"), (12, "  w　v", "d"), (13, "it's what's\t\tup 123,45 <|endoftext|> \r\n x", "d"),
    *((20 + i, near(i), "a") for i in range(12)), (40, " ".join(BASE * 2), "a"), (41, " ".join(BASE * 2), "a"), (42, " ".join(BASE[:21]), "b"), (43, "z " * 60, "b"),
    (44, "same line here\nuser 17 logged in\nother", "a"), (None, "no id", "a"), (None, "no id", "a"), (45, "repeated row", "e"), (45, "repeated row", "e"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with extra columns whose names the operators use inside."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return rows.withColumns({c: F.lit(c) for c in ("row", "n", "a", "b", "tile", "hash", "part", "cut", "lines", "size", "taken", "lang", "no", "marks", "score", "__w")}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def brute_components(texts: dict, k: int, percent: int) -> tuple[dict, dict]:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_word_hashes_follow_words():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab C\t\né")) for _ in range(rng.integers(0, 40))) for _ in range(300)]
    block = words.Words([t.encode() for t in texts])
    found = [w for t in texts for w in WORD.findall(t)]
    assert [block.data[s:e].tobytes().decode() for s, e in zip(block.start, block.end, strict=True)] == found
    assert len(set(zip(found, block.hashes().tolist(), strict=True))) == len(set(found)) == len(set(block.hashes().tolist()))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(odd, none, k, percent):
    got = ngram_join.ngram_jaccard_components(odd, k, percent).toPandas()
    root, size = brute_components({i: t for i, t, _ in ODD if i is not None}, k, percent)
    assert len(got) == len(ODD)
    known = got[got.doc_id.notna()]
    assert dict(zip(known.doc_id.astype(int), known.component_id.astype(int), strict=True)) == root
    assert dict(zip(known.doc_id.astype(int), known.n_shingles, strict=True)) == size
    assert got[got.doc_id.isna()].component_id.isna().all()
    assert ngram_join.ngram_jaccard_components(none, k, percent).count() == 0


def test_ngram_join_finds_chains_beyond_the_hub(spark):
    rng = np.random.default_rng(5)
    texts, current = {}, [f"v{i}" for i in range(80)]
    for i in range(60):  # neighbours are similar, ends are not
        texts[i] = " ".join(current)
        current[int(rng.integers(80))] = f"n{i}"
    texts |= {100 + i: " ".join(rng.choice([f"u{j}" for j in range(30)], 12)) for i in range(80)}
    root, _ = brute_components(texts, 2, 70)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_jaccard_components(docs, 2, 70).collect()
    assert {r.doc_id: r.component_id for r in got} == root


def test_tiles_with_equal_members_are_compared_once(spark, monkeypatch):
    """What a member of a tile brings along grows neither with the tiles that have the same members nor with all tiles of its document."""
    tiles, docs = 60, (1, 2, 3)
    linked = [(t, 1, d) for t in range(tiles) for d in docs[1:]] + [(tiles + d, d, 10 + d) for d in docs] + [(100 + t, 1, 20 + t) for t in range(30)]
    stars = stored(spark.createDataFrame(linked, "tile long, hub long, doc long"))
    ids = [r.doc for r in stars.select("doc").union(stars.select("hub")).distinct().collect()]
    shingles = np.sort(np.random.default_rng(3).integers(1 << 60, size=100).astype(np.uint64))
    sets = spark.createDataFrame([(d, 100, ngram_join.bitmap(shingles)) for d in ids], "doc_id long, n long, bits binary")
    parts = spark.createDataFrame([], "node long, component long")
    met = []
    monkeypatch.setattr(ngram_join, "mapped", lambda df, function, schema: met.append(df) or frames.mapped(df, function, schema))
    pairs = ngram_join._across_tiles(stars, stars.select("tile").distinct(), sets, parts, 80).distinct()
    want = {(a, b) for a in docs for b in docs if a < b} | {(d, 10 + d) for d in docs} | {(1, 20 + t) for t in range(30)}
    assert {tuple(r) for r in pairs.collect()} == want
    rows = met[0].collect()
    assert len(rows) == 3 + 2 * 3 + 2 * 30
    assert max(len(r.earlier) for r in rows) <= ngram_join.EARLIER


def test_overlap_bound_is_a_bound():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, int(rng.integers(1, 200)))) for _ in range(2))
        assert ngram_join.overlap_bound(ngram_join.bitmap(x), len(x), ngram_join.bitmap(y), len(y)) >= len(np.intersect1d(x, y))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_duplicates(odd).toPandas()
    groups: dict[str, list] = {}
    for i, t, _ in ODD:
        groups.setdefault("".join(WORD.findall(t or "")), []).append((-len(t or ""), i is None, i))
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): g for n, g in groups.items()}
    assert len(got) == len(ODD)
    for sha, rows in got.groupby("text_sha256"):
        best = sorted(by_sha[sha], key=lambda x: (x[0], x[1], x[2] or 0))[0][2]
        assert rows.group_size.tolist() == [len(by_sha[sha])] * len(rows)
        assert rows.kept.sum() == 1
        assert rows.keep_id.isna().all() if best is None else set(rows.keep_id) == {best}
        assert best is None or rows[rows.kept].doc_id.tolist() == [best]
    assert exact_dedup.exact_duplicates(none).count() == 0
    kept = exact_dedup.keep_one_of_equal(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(groups)


def test_fingerprints_compose():
    rng = np.random.default_rng(4)
    data = rng.bytes(50_000)
    assert all(pow(a, exact_dedup.PRIME - 1, exact_dedup.PRIME) == 1 for a in (2, 3, 5, 7, 11))
    whole = exact_dedup.chunk_fingerprint(data)
    for size in (1, 7, 4096, 60_000):
        assert exact_dedup.fingerprint(data, size) == whole
    a, b, c = (exact_dedup.chunk_fingerprint(x) for x in (data[:11], data[11:500], data[500:]))
    assert exact_dedup.combine(exact_dedup.combine(a, b), c) == exact_dedup.combine(a, exact_dedup.combine(b, c)) == whole


def test_huge_texts_are_hashed_in_parallel(odd, monkeypatch):
    """Chunk by chunk in rows of their own, every text has the fingerprint that it has in one piece."""
    docs = odd.select("doc_id", "text")
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows.collect())
    whole = key(exact_dedup.text_digests(docs))
    monkeypatch.setattr(exact_dedup, "HUGE_CHARS", 3)
    monkeypatch.setattr(exact_dedup, "ROW_CHARS", 1000)
    assert key(exact_dedup.text_digests(docs)) == whole
    assert exact_dedup.text_digests(docs.limit(0)).count() == 0


def test_collisions_are_split(odd, monkeypatch):
    # every text collides; the chunkwise comparison must tell them apart
    original = exact_dedup._digests

    def weak(batches):
        for batch in original(batches):
            zero = pa.array([0] * batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), zero, zero, zero, batch.column("n_chars"), batch.column("text_sha256")], names=batch.schema.names)

    monkeypatch.setattr(exact_dedup, "_digests", weak)
    got = exact_dedup.exact_duplicates(odd).toPandas()
    assert got.kept.sum() == got.text_sha256.nunique()
    assert (got.groupby("text_sha256").size() == got.groupby("text_sha256").group_size.first()).all()


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """Rows of one id are one document: a start counts once, and what one loses all lose that reach so far."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a + " " + b), (2, "short row"), (3, b), (3, b), (4, a), (4, "four words and nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_passages(docs, 20).collect())
    assert got == [(1, 60, 0), (2, 2, 2), (2, 100, 60), (3, 40, 40), (3, 40, 40), (4, 4, 4), (4, 60, 60)]


@pytest.mark.parametrize("window", [20, 5, 2])
def test_substring_dedup(odd, none, window):
    got = substring_dedup.remove_repeated_passages(odd, window).collect()
    seen: set = set()
    expected = {}
    for i, t in sorted({i: t for i, t, _ in ODD if i is not None}.items()):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        expected[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id is None:
            assert (r.n_words, r.n_removed, r.kept_text) == (2, 0, "no id")
        else:
            assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id], r.doc_id
            assert sum(s.stop - s.start for s in r.removed_spans) == r.n_removed
    assert substring_dedup.remove_repeated_passages(none, window).count() == 0


def test_covers_meet_every_shift():
    for period, cover in substring_dedup.COVERS.items():
        for a in range(period):
            for b in range(period):
                assert any((a + s) % period in cover and (b + s) % period in cover for s in range(period))


PAGES = [
    (1, "<html><head><title>T</title><script>if(a<b){'</p>'}</script></head><body><nav><a href=x>Home</a></nav><article><header><h1>Big title</h1></header><p>First &amp; <b>bold</b> part,\n  long enough to read.<p>Second part with a <a href=y>link</a> inside it.</p></article><footer>&copy; all rights</footer></body></html>", "Big title\nFirst & bold part, long enough to read.\nSecond part with a link inside it."),
    (2, "<div class='cookie-notice'>We use cookies on this site, please accept all of them now.</div><div class=content><p>Only paragraph of this page, which says one thing at some length.</p></div><div id=comments><p>Reader: what a lovely article, I would like to read far more of it.</p></div><aside>Related</aside><form><p>Subscribe to our letter now, it is for free and it is good.</p></form>", "Only paragraph of this page, which says one thing at some length."),
    (3, None, ""), (4, "", ""), (5, "<p></p><br>", ""), (6, "<article><p>Unclosed text of some length that goes on, as texts do.<ul><li>one item<li>two items</ul><style>p{}</style>", "Unclosed text of some length that goes on, as texts do.\none item\ntwo items"),
    (7, "<article>" + "<p>" + "word " * 20_000 + "</p><p>tail &#233;&eacute; end of it all.</p></article>", " ".join(["word"] * 20_000) + "\ntail éé end of it all."),
    (None, "<article><p>No id but text, which is all the same here.</p></article>", "No id but text, which is all the same here."),
    (8, "<article class='post legal'><p>" + "One long paragraph of law text. " * 20 + "</p></article>", ("One long paragraph of law text. " * 20).strip()),
    (9, "<article><p>Intro of a text about a drug, at some length.</p><section id='side-effects'><p>" + "Headaches are common. " * 5 + "</p></section></article>", "Intro of a text about a drug, at some length.\n" + ("Headaches are common. " * 5).strip()),
    (10, "<div class='post tag-health'><p>" + "Sleep well and long. " * 10 + "</p></div>", ("Sleep well and long. " * 10).strip()),
    (11, "<p>Short text</p>", "Short text"), (12, "<nav><a href=x>Home</a> <a href=y>Away</a></nav>", ""), (13, "<div class='ad'>Buy now</div>", ""),
    (14, "<div class='legal'><p>" + "These terms hold for all users. " * 20 + "</p></div>", ("These terms hold for all users. " * 20).strip()),
    (15, "<p>First part of the text, which is long enough to be content.</p><select><option>one<p>Second part of the text, also long enough to be content.</p>", "First part of the text, which is long enough to be content.\none\nSecond part of the text, also long enough to be content."),
    (16, "<div\nclass=\"sidebar\"\tid=x><p>Sidebar text that is long enough to look like content, with a full stop.</p></div><article><p>Main text of this page, which is what we want to see.</p></article>", "Main text of this page, which is what we want to see."),
    (17, "<form id=all><div class=content><p>" + "Text in a form that wraps the page. " * 12 + "</p></div></form>", ("Text in a form that wraps the page. " * 12).strip()),
    (18, "<article><p>The article says this and that, at some length indeed.</p><div id='comments'><p>" + "Reader says a lot about it. " * 40 + "</p></div></article>", "The article says this and that, at some length indeed."),
    (19, "<div><b>" * 4000 + "Deep text, which is still read as it stands." + "</i>" * 4000, "Deep text, which is still read as it stands."),
    (11, "<p>Short text</p>", "Short text"),
]


def test_html_extraction(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h, _ in PAGES], "page_id long, url string, html string, text string")
    got = html_extract.extract_main_text(pages).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == {i: (f"u{i}", t, len(t)) for i, _, t in PAGES}
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_main_text_of_the_table_is_the_article(small):
    """On the test pages all content, and nothing else, is inside ``article``: block by block the same."""
    import html as escapes

    import pyarrow.parquet as pq

    borders = re.compile(r"</?(?:p|h1|h2|h3|li|ul|ol|div|blockquote|table|tr|td)[^>]*>")
    for page in pq.read_table(f"{small}/pages.parquet").column("html").to_pylist():
        inside = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer|$)", page or "", re.S)
        blocks = borders.split(re.sub(r"<br>|</?b>", " ", inside[1])) if inside else []
        expected = [x for b in blocks if (x := " ".join(escapes.unescape(re.sub(r"<[^>]+>", "", b)).split()))]
        assert html_extract.main_text(page).split("\n") == (expected or [""])


def test_minimum_cut_is_the_least_labelling():
    rng = np.random.default_rng(6)
    for _ in range(60):
        blocks = [html_extract.Block(int(rng.integers(3)), int(rng.integers(2)), float(rng.normal(0, 2)), "p", linked=int(rng.integers(20)), text="x" * int(rng.integers(1, 90))) for _ in range(9)]
        edges, last = [], {}
        for i, b in enumerate(blocks):
            if i:
                edges.append((i - 1, i, round(1000 * (html_extract.NEAR if b.region == blocks[i - 1].region else html_extract.FAR))))
            if b.container in last and last[b.container] != i - 1:
                edges.append((last[b.container], i, round(1000 * html_extract.SIBLING)))
            last[b.container] = i
        unary = [round(1000 * html_extract.belief(b)) for b in blocks]

        def cost(labels):
            return sum(max(0, -u) if on else max(0, u) for u, on in zip(unary, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(9)]) for m in range(512))
        assert cost(html_extract.label_blocks(blocks)) == best


def brute_mix(rows: list[tuple], weights: tuple = (1, 2, 3), most: int = 3) -> list[dict]:
    """What the mix takes of each (doc_id, text, source), by a loop over the words of the schedule's slots."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, target, free = sum(own.values()), {}, list(sources)
    while free:  # sources above their limit take it, the others share what is left
        left = total - sum(target.values())
        rate = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rate > most * own[s]]
        target |= {s: float(most * own[s]) for s in over} if over else {s: weight[s] * rate for s in free}
        free = [s for s in free if s not in over] if over else []
    width = max(1, min(mixing.SLOT_WORDS, total // max(1, len(sources)) // mixing.SLOTS_PER_SOURCE))
    n_slots, ends, at = -(-total // width), {}, 0.0
    for s in sources:
        ends[s] = (round(at / total * 2**31) if total else 0, round((at + target[s]) / total * 2**31) if total else 0)
        at += target[s]
    slots: dict = {s: [] for s in sources}
    for i in range(n_slots):
        x = i * mixing.GOLDEN % 2**31
        slots[next(s for s in sources if ends[s][0] <= x < ends[s][1])].append(i)
    out = [{"taken": 0, "slots": [], "at": []} for _ in rows]
    for turn, s in enumerate(sources):
        need = math.ceil(target[s] / width)
        ranks = slots[s][:need] + [n_slots + r * len(sources) + turn for r in range(len(slots[s]), need)]
        text_hash = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 2**63) - 2**63
        order = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (hashlib.md5(str(rows[i][0] if rows[i][0] is not None else "").encode()).hexdigest(), rows[i][0] or 0, size[i], text_hash(rows[i][1])))
        words = [i for _ in range(most) for i in order for _ in range(size[i])][: math.floor(target[s])]
        for place, (i, again) in enumerate(zip(words, [t for t in range(most) for i in order for _ in range(size[i])], strict=False)):
            out[i]["taken"] += 1
            out[i]["slots"].append(ranks[place // width])
            out[i].setdefault(again, []).append(ranks[place // width])
    for i, o in enumerate(out):
        o["at"] = [o[t][0] for t in range(most) if 2 * len(o.get(t, [])) >= max(1, size[i])]
    return out


def test_mixing(spark, odd, none):
    expected = brute_mix(ODD)
    wanted = sorted((str(r[0]), o["taken"], min(o["slots"], default=-1), max(o["slots"], default=-1)) for r, o in zip(ODD, expected, strict=True))
    for rows in (odd, odd.repartition(7)):
        got = mixing.mix_sources(rows).collect()
        assert sorted((str(r.doc_id), r.taken, -1 if r.first_slot is None else r.first_slot, -1 if r.last_slot is None else r.last_slot) for r in got) == wanted
    frame = mixing.mix_sources(odd).toPandas()
    firsts = frame.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(firsts.target.sum() - frame["size"].sum()) < 1e-6 * frame["size"].sum()
    assert (np.floor(firsts.target + 1e-9) - firsts.taken).abs().max() <= 1
    assert mixing.mix_sources(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_sources(blank).collect()] == [0, 0]
    assert mixing.mixed_documents(blank).count() == 2
    assert mixing.mixed_documents(none).count() == 0
    # rows without words stay once; equal rows share their copies evenly
    times: dict = {}
    for r, o in zip(ODD, expected, strict=True):
        times.setdefault(r, []).append(len(o["at"]))
    wanted = sorted((str(r[0]), str(r[1])) for r, n in times.items() for _ in range(len(n) * (1 if not WORD.findall(r[1] or "") else (2 * sum(n) + len(n)) // (2 * len(n)))))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in mixed.collect()) == wanted


def test_mix_tells_rows_of_one_hash_apart(spark):
    rows = [(None, f"{'w ' * (1 + i % 3)}t{i}", "a" if i % 4 else None) for i in range(29)] + [(7, "one text", "b"), (7, "another longer text", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = sorted((len(WORD.findall(r[1])), str(r[2]), o["taken"], min(o["slots"], default=-1)) for r, o in zip(rows, brute_mix(rows), strict=True))
    for n in (1, 5):
        got = mixing.mix_sources(docs.repartition(n)).collect()
        assert sorted((r["size"], str(r.source), r.taken, -1 if r.first_slot is None else r.first_slot) for r in got) == wanted


def test_mixed_documents_follow_the_schedule(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    wanted = sorted((slot, r[0]) for r, o in zip(rows, brute_mix(rows), strict=True) for slot in o["at"])
    none = [r[0] for r in rows if not WORD.findall(r[1] or "")]
    got = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    assert sorted(got) == sorted([d for _, d in wanted] + none)
    place = {d: i for i, (_, d) in enumerate(reversed(wanted))}
    first = [d for i, d in enumerate(got) if d not in got[:i] and d in place]
    assert first == sorted(first, key=lambda d: next(s for s, x in wanted if x == d))


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 1000, 600.0), ("b", 500, 300.0), (None, 100, 100.0)], "source string, source_size long, target double")
    slots = mixing.slot_schedule(targets, 1, 1000).toPandas()
    for source, target in (("a", 600), ("b", 300), (None, 100)):
        own = slots[slots.source.isna() if source is None else slots.source == source]
        assert sorted(own["rank"]) == list(range(target))
        placed = own.sort_values("rank")
        assert placed.slot.is_monotonic_increasing
        gap = placed["rank"] + 1 - (placed.slot + 1) * target / 1000
        assert gap[placed.slot < 1000].abs().max() < 5
        assert (placed.slot >= 1000).sum() < 5
    assert slots.slot.is_unique


def test_languages(spark, odd, none):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages_of(rows).join(rows.select("doc_id", "lang"), "doc_id").toPandas()
    assert {(i % 3 == 1) for i in [zlib.crc32(str(d).encode()) for d in got[got.held_out].doc_id]} == {True}
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    out = {r.doc_id: r.lang_pred for r in language.languages_of(odd.withColumn("lang", F.lit("en"))).collect()}
    assert all(out[i] == "und" for i in (1, 2, 3))
    assert out[4] == "en"
    assert language.languages_of(none).count() == 0
    assert {r.lang_pred for r in language.languages_of(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_of(docs, labels)
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.97
    assert got.count() == docs.count()
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 1").count()
    labels_none = labels.limit(0)
    assert quality.quality_of(odd, labels_none).where("score between 0 and 1").count() == len(ODD)
    assert quality.quality_of(none, labels).count() == 0


def plain_features(text: str | None) -> dict:
    """Features by name: words, shapes and pairs of both with their relative frequencies."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    kinds = lambda w: [1 if b >= 128 or 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else b for b in w.encode()]
    shapes = [tuple(k for i, k in enumerate(kinds(w)) if not i or kinds(w)[i - 1] != k) for w in WORD.findall(text or "")]
    views = {"w": words, "s": shapes, "ww": list(zip(words, words[1:], strict=False)), "ss": [(a, b, x == y) for a, b, x, y in zip(shapes, shapes[1:], words, words[1:], strict=False)]}
    out: dict = {}
    for view, found in views.items():
        for f in found:
            out[view, f] = out.get((view, f), 0.0) + quality.SCALE / len(found)
    return out


class PlainFtrl:
    """Follow-the-regularised-leader, one coordinate at a time."""

    def __init__(self):
        self.z, self.n = {}, {}

    def weight(self, key) -> float:
        z, n = self.z.get(key, 0.0), self.n.get(key, 0.0)
        lead = 0.0 if key == "intercept" else quality.L1
        return 0.0 if abs(z) <= lead else -(z - math.copysign(lead, z)) / ((quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2)

    def score(self, x: dict) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(self.weight(k) * v for k, v in {**x, "intercept": 1.0}.items())))))

    def learn(self, x: dict, label: float) -> None:
        p, weights = self.score(x), {k: self.weight(k) for k in [*x, "intercept"]}
        for k, v in {**x, "intercept": 1.0}.items():
            g, n = (p - label) * v, self.n.get(k, 0.0)
            self.z[k] = self.z.get(k, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / quality.ALPHA * weights[k]
            self.n[k] = n + g * g


def test_quality_as_plain_ftrl(spark):
    rng = np.random.default_rng(12)
    good, junk = ["clear", "words", "that", "Tell", "a", "story", "é1"], ["BUY", "now!!!", "$$$", "click", "x9x", "aa", "--==--==--"]
    docs = [(i, " ".join(rng.choice(good if i % 3 else junk, int(rng.integers(0, 12))))) for i in range(90)] + [(200, None), (201, "never seen"), (None, "Tell a story")]
    labels = [(i, int(i % 3 > 0)) for i in range(80)] + [(5, None), (6, 1), (300, 1)]
    known = {i: min(q for j, q in labels if j == i and q is not None) for i, _ in labels if i < 80 and zlib.crc32(str(i).encode()) % 5}
    hashed = {i: (xxhash.xxh64_intdigest(struct.pack("<q", i), 42) ^ 2**63) - 2**63 for i in known}
    shards: dict = {}
    for i in sorted(known, key=lambda i: hashed[i]):
        shards.setdefault((hashed[i] // 64 if hashed[i] >= 0 else -(-hashed[i] // 64)) % quality.SHARDS, []).append(i)
    texts = dict(docs)
    models = []
    for ids in shards.values():
        model = PlainFtrl()
        for turn in range(quality.EPOCHS):
            for i in np.random.default_rng(turn).permutation(len(ids)):
                model.learn(plain_features(texts[ids[i]]), known[ids[i]])
        models.append((len(ids), model))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = quality.quality_of(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(docs)
    for r in got:
        x = {**plain_features(texts[r.doc_id]), "intercept": 1.0}
        logit = sum(n * sum(m.weight(k) * v for k, v in x.items()) for n, m in models) / sum(n for n, _ in models)
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)
        assert r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_languages_as_plain_hypervectors(spark):
    rng = np.random.default_rng(13)
    spoken = {"xx": "abcde", "yy": "cdefg", "zz": "αβγδε"}
    docs = [(i, " ".join("".join(rng.choice(list(spoken[lang]), int(rng.integers(1, 6)))).title() for _ in range(int(rng.integers(1, 9)))) + "! 12", lang) for i in range(60) for lang in [list(spoken)[i % 3]]]
    docs += [(100, "12 -- 3", "xx"), (101, None, "xx"), (102, "abc", None), (None, "edc ba", "xx")]

    def profile(text: str | None) -> np.ndarray | None:
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not letters.strip():
            return None
        letters = " " + " ".join(letters.split()) + " "
        total = np.zeros(language.DIMENSIONS)
        for i in range(len(letters) - 2):
            run = np.ones(language.DIMENSIONS)
            for place in range(3):
                own = language.letter_vector(ord(letters[i + place]))
                run = run * np.array([own[(d - place) % language.DIMENSIONS] for d in range(language.DIMENSIONS)])
            total += run
        return total / np.linalg.norm(total)

    found = {r[0]: profile(r[1]) for r in docs}
    sums = {lang: sum(found[i] for i, t, x in docs if x == lang and i is not None and found[i] is not None and zlib.crc32(str(i).encode()) % 3 != 1) for lang in spoken}
    got = language.languages_of(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(docs)
    for r in got:
        own = found[r.doc_id]
        cosine = {lang: 0.0 if own is None else own @ v / np.linalg.norm(v) for lang, v in sums.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r.lang_pred == ("und" if own is None else best)
        assert r.score == pytest.approx(max(0.0, cosine[best]), abs=1e-5)


def test_line_dedup(spark, odd, none):
    lines = [(i, f"header of all\nuser {i} logged in from host{i}\nbody number {'abcdefgh'[i]} is its own text\n\n{'unique' + 'xyz'[i % 3]} words {'qrstuvwx'[i]}") for i in range(8)]
    docs = spark.createDataFrame([*lines, (50, None), (51, ""), (52, "header of all")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_template_lines(docs).collect()}
    assert got[50] == got[51] == (0, 0, "")
    assert got[52] == (1, 1, "")
    for i, text in lines:
        assert got[i][0] == 5
        assert "header" not in got[i][2]
        assert "logged" not in got[i][2]
        assert text.split("\n")[4] in got[i][2]
    assert line_dedup.drop_template_lines(odd).count() == len(ODD)
    assert line_dedup.drop_template_lines(none).count() == 0


def test_short_clean_lines_stay(spark):
    """Lines that share only the leading words of their leaf, and five-word lines that share one word more."""
    names = [f"{a}{b}" for a in "bcdfg" for b in ("ale", "orn", "ith", "ush")]
    clean = [(i, f"Was erlytion that. {n}a {n}e\nWas erlytion that. {n}i") for i, n in enumerate(names)]
    named = [(100 + i, f"Posted on behalf of {n}") for i, n in enumerate(names)]
    got = {r.doc_id: r for r in line_dedup.drop_template_lines(spark.createDataFrame([*clean, *named], "doc_id long, text string")).collect()}
    assert all((got[i].n_dropped, got[i].kept_text) == (0, t) for i, t in clean)
    assert all((got[i].n_dropped, got[i].kept_text) == (1, "") for i, _ in named)


def test_further_templates_of_a_leaf(spark):
    """Three templates of one leaf, two of them with a word of their own in every document, and clean lines."""
    names = [f"{a}{b}" for a in "bcdfg" for b in ("ale", "orn", "ith", "ush")]
    lines = {
        "sales": [(i, "Please contact our sales team at any time of day") for i in range(30)],
        "agent": [(200 + i, f"Please contact our agent {n} about the new house offer") for i, n in enumerate(names)],
        "desk": [(300 + i, f"Please contact our desk in {n} with every other question") for i, n in enumerate(names[:5])],
        "clean": [(400 + i, "Please contact our " + " ".join(n + x for x in "qwertyz")) for i, n in enumerate(names)],
        "few": [(500 + i, f"Please contact our lawyers near {n} before signing any contract") for i, n in enumerate(names[:4])],
    }
    docs = spark.createDataFrame(sum(lines.values(), []), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_template_lines(docs).collect()}
    assert {k: {got[i] for i, _ in v} for k, v in lines.items()} == {"sales": {1}, "agent": {1}, "desk": {1}, "clean": {0}, "few": {0}}


def test_topk(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 6), (1100, [float("inf")] * 6), (None, [1.0] * 6), (1150, [0.5, 0.25])]
    rows += [(400 + i, [0.25] * 6) for i in range(90)]
    got = topk.exact_topk(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)).collect()
    known = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v is not None and len(v) == 6 and None not in v and np.isfinite(np.array(v, float)).all()}
    expected = []
    for q in (i for i in known if i % 50 == 0):
        ranked = sorted(((-int(known[q] @ v), i) for i, v in known.items() if i != q))[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(expected)
    assert topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 24, 1 << 30])
@pytest.mark.parametrize("n", [3, 300, 2000])
def test_topk_blocks_at_every_precision(scale, n):
    rng = np.random.default_rng(8)
    x, q = rng.integers(-scale, scale + 1, (n, 8)), rng.integers(-scale, scale + 1, (9, 8))
    ids, asked = rng.permutation(n).astype(np.int64), np.arange(-9, 0)
    asked[3], q[3], q[0] = ids[1], x[1], 0
    which, at, score, reads = topk.block_topk(x.astype(float), ids, q.astype(float), asked, 4)
    assert (reads <= n * 8).all()
    for i in range(9):
        dots = [sum(int(a) * int(b) for a, b in zip(q[i], row, strict=True)) for row in x]
        best = sorted((j for j in range(n) if ids[j] != asked[i]), key=lambda j: (-dots[j], ids[j]))[:4]
        assert at[which == i].tolist() == best
        assert score[which == i].tolist() == [dots[j] for j in best]


def test_topk_stops_early_where_lists_tell_apart():
    """Few strong components a vector: a first short read is enough; vectors without structure need half of every list."""
    rng = np.random.default_rng(11)
    weak = rng.integers(-4, 5, (4000, 32)).astype(float)
    strong = weak.copy()
    for row in strong:
        row[rng.integers(0, 32, 2)] += 250
    for x, least, most in ((strong, 0.0, 0.25), (weak, 0.25, 0.6)):
        q = x[:20]
        which, at, score, reads = topk.block_topk(x, np.arange(4000), q, np.arange(20), 5)
        assert least < reads.mean() / x.size <= most
        exact = q @ x.T
        exact[np.arange(20), np.arange(20)] = -np.inf
        for i in range(20):
            assert score[which == i].tolist() == sorted(exact[i].tolist(), reverse=True)[:5]


def test_topk_of_large_values(spark):
    rows = [(50, [1e20, 1.0]), (1, [1e20, 1.0]), (2, [-1e20, 0.0]), (3, [1e14, 1.0]), (4, [1e308, 1.0]), (5, [0.0, 1.0])]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect()
    # 256 * 1e308 is not finite; what no long can hold is held at its ends
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 2**63 - 1), (2, 3, 2**63 - 1), (3, 5, 65536), (4, 2, -(2**63))]


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(odd, path).toPandas()
    expected = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in ODD if i is not None and i != 45)
    whole = []
    for _, pieces in got[got.doc_id.notna() & (got.doc_id != 45)].sort_values("start").groupby("doc_id"):
        assert (pieces.start + pieces.length).tolist()[:-1] == pieces.start.tolist()[1:]
        assert set(pieces.doc_tokens) == {pieces.length.sum()}
        whole.append(np.concatenate([np.frombuffer(x, "<u4") for x in pieces.ids]).tolist())
    assert sorted(whole) == expected
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]]
        n = pieces.length.sum()
        assert n <= 2048
        assert n == 2048 or n & (n - 1) == 0
    assert packing.pack_documents(none, path).count() == 0


def test_units_do_not_depend_on_what_is_around_them():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    tokenizer = Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab 'sé1!\t\n\r  中"), int(rng.integers(0, 30)))) for _ in range(400)]
    texts += ["<|endoftext|>", " a <|endoftext|> b", "x<|endoftext|>y <|endoftext", "no<0xA0>break\u00a0space"]
    encoder = packing.Encoder(path)
    # in blocks, so that units of earlier ones are remembered
    got = [ids for i in range(0, len(texts), 50) for ids in encoder.encode([t.encode() for t in texts[i : i + 50]])]
    assert got[400].tolist() == [50256]
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_placement_minimises_squares():
    packer = packing.Packer(16)
    rng = np.random.default_rng(10)
    for n in rng.integers(1, 16, 400):
        before = packer.level.copy()
        at = packer.place(int(n))

        def squares(h, n=int(n), before=before):
            level = before.copy()
            if h:
                level[h] -= 1
            if h + n < 16:
                level[h + n] += 1
            return int((level[1:16] ** 2).sum())

        options = [h for h in range(17 - n) if not h or before[h] > 0]
        assert squares(at) == min(map(squares, options))
        list(packer.add((0, 0, np.zeros(int(n), np.uint32), 0)))
    assert packer.level[1:16].tolist() == [len(packer.open.get(h, ())) for h in range(1, 16)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small).toPandas(), connect(small).execute(ORACLES[name]).df())


def counted(rows) -> Counter:
    return Counter((r.doc_id, r.text) for r in rows)


def brute_stage(name: str, before: list, spark, docs, folder: str) -> Counter:
    """Documents that a stage of the pipeline should return, from those that it is given."""
    if name == "quality":
        scored = quality.quality_of(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
        good = Counter(r.doc_id for r in scored if r.score >= 0.3)
        bad = {r.doc_id for r in scored if r.score < 0.3}
        assert not bad & set(good), "ids of both kinds need another test"
        return Counter({k: n for k, n in counted(before).items() if k[0] in good})
    if name == "exact_dedup":
        groups: dict = {}
        for r in before:
            groups.setdefault("".join(WORD.findall(r.text or "")), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r))
        return counted(min(g, key=lambda x: x[:3])[3] for g in groups.values())
    if name == "near_dedup":
        root, _ = brute_components({r.doc_id: r.text for r in before if r.doc_id is not None}, 5, 80)
        return counted(r for r in before if r.doc_id is None or root[r.doc_id] == r.doc_id)
    rows = [(r.doc_id, r.text, r.source) for r in before]
    return Counter({(r[0], r[1]): n for r, o in zip(rows, brute_mix(rows), strict=True) if (n := len(o["at"]) if WORD.findall(r[1] or "") else 1)})


def check_packed(pieces: list, docs: list) -> None:
    """Every document's ids lie in its pieces once, as often as it is there."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    wanted: Counter = Counter()
    for r in docs:
        wanted[r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1] += 1
    length: Counter = Counter()
    for r in pieces:
        length[r.doc_id, r.doc_tokens] += r.length
    assert dict(length) == {k: k[1] * n for k, n in wanted.items()}


def test_pipeline(spark, small):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    rows, before = docs, docs.collect()
    for name, stage in pipeline.STAGES:
        done = stored(stage(spark, rows, small))
        after = done.collect()
        if name == "packing":
            check_packed(after, before)
        else:
            assert done.columns == docs.columns
            assert counted(after) == brute_stage(name, before, spark, rows, small)
        rows, before = done, after
    cut = lambda found: sorted((r.doc_id, r.doc_tokens) for r in found if not r.start)
    whole = pipeline.run(spark, small).collect()
    assert cut(whole) == cut(before)
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0, name


def test_pipeline_on_odd_rows(spark, odd, small):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns with the operators' names."""
    import corpus_pipeline as pipeline

    rows = stored(odd)
    for name, stage in pipeline.STAGES:
        before = rows.collect()
        done = stored(stage(spark, rows, small))
        after = done.collect()
        if name == "packing":
            check_packed(after, before)
        elif name == "quality":
            assert done.columns == odd.columns
            assert not counted(after) - counted(before)
            assert {None, ""} <= {r.text for r in after}, "texts without words have the score of the intercept"
        else:
            assert done.columns == odd.columns
            assert counted(after) == brute_stage(name, before, spark, rows, small)
        rows = done


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op3_substring_dedup", "op6_exact_dedup", "op8_line_dedup"])
def test_lists_too_long_for_broadcast(spark, small, name, monkeypatch):
    """The shuffle side of :func:`frames.sized` gives the same rows."""
    plain = frames.sized
    for module in (frames, ngram_join, substring_dedup, exact_dedup, line_dedup, mixing):
        if hasattr(module, "sized"):
            monkeypatch.setattr(module, "sized", lambda df: plain(df, -1))
    same(queries.QUERIES[name](spark, small).toPandas(), connect(small).execute(ORACLES[name]).df())
