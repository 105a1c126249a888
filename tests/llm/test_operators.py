"""Operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, other columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import common, components, fingerprints, html_text, language_id, mixing, near_dup, packing, quality, repeats, token_store, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = prose(rng, 300)
    out = [(i, prose(rng, rng.randrange(1, 200))) for i in range(40)]
    words = base.split()
    for i in range(40, 60):  # near copies
        copy = list(words)
        for _ in range(i - 40):
            copy[rng.randrange(len(copy))] = "changed"
        out.append((i, " ".join(copy)))
    out += [(60, base), (61, base.upper()), (62, None), (63, ""), (64, " \n\t "), (65, "one"), (66, "Übér 你好\nß\r\n\x0b x"), (67, prose(rng, 9_000)), (68, "a" * 3_000), (69, "ab " * 900)]
    shared = prose(rng, 120)
    out += [(i, prose(rng, 30) + shared + prose(rng, 30)) for i in range(70, 76)]
    out += [(60, base), (65, "one")]  # repeated rows
    return [(i, t, None if i % 9 == 0 else "xx" if i % 2 else "yy", None if i % 7 == 0 else f"s{i % 4}", 1, 5, "clash") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_against_brute_force(docs, rows, nothing):
    got = Counter((r.doc_id, r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) for r in quality.clean_lines(docs).collect())
    want = Counter()
    for i, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if seen[x] > 1:
                covered.update(range(k, k + 8))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))] += 1
    assert got == want
    assert quality.clean_lines(nothing).count() == 0


def test_quality_rules(spark):
    lines = {"A fine line of prose that ends as it should.": False, "Home | News | Sport | Contact | Help": True, "BUY!! NOW!! CHEAP!! BOOTS!!": True, "Menu": True, "we use cookies to serve you": True, "x%%% y*** z### w$$$ v&&&": True, "A long line of verse without a closing mark": False}
    got = {r.line: r.f for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", quality.line_fails(F.col("line")).alias("f")).collect()}
    assert got == lines


def test_language_held_out(spark, nothing):
    rng = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "un", "ber", "ge"], "cc": ["eau", "ion", "ré", "ç"]}
    data = [(i, " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(40)), x, None, 1, 1, "") for i, x in enumerate(random.Random(1).choices(sorted(parts), k=300))]
    data += [(1_000, None, "aa", None, 1, 1, ""), (1_001, "12 %%", "aa", None, 1, 1, ""), (1_002, "kalomi", None, None, 1, 1, "")]
    docs = spark.createDataFrame(data, SCHEMA)
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [d for d in data if d[0] < 300 and zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert len(held) > 40 and all(got[i].lid_lang == x for i, _, x, *_ in held)
    assert [(got[i].lid_lang, got[i].lid_score) for i in (1_000, 1_001)] == [("und", 0.0)] * 2
    assert all(0 <= r.lid_score <= 1 for r in got.values())
    empty = language_id.fit(nothing)
    assert language_id.identify(nothing, empty).count() == 0
    assert {r.lid_lang for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_repeats_against_brute_force(docs, rows, nothing):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = Counter()
    for i, b in raw:
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                mask[k : k + 400] = True
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        want[(i, len(b), int(mask.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest())] += 1
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == want
    assert sum(k[2] > 0 for k in want) > 8
    assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_across_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1_000)
    rng = random.Random(2)
    a, b = prose(rng, 800), prose(rng, 300)
    texts = [a + b, prose(rng, 50) + b, a[777:2_500]]
    raw = [t.encode() for t in texts]
    hasher = repeats._Hasher()
    with np.errstate(over="ignore"):
        for t in raw:
            data = np.frombuffer(t, np.uint8)
            found = [np.concatenate(x) for x in zip(*repeats._phrases(data, hasher), strict=True)]
            assert found[1][0] == 0 and found[2][-1] == len(t) - 400 and (found[1][1:] == found[2][:-1] + 1).all()
            assert ((found[0] >= found[2]) & (found[0] <= found[1] + 400 - repeats.GRAM)).all()


def test_repeated_words_against_brute_force(spark, docs, rows):
    rng = random.Random(11)
    short = [" ".join(rng.choices(["a", "of", "it", "we", "é", "on"], k=n)) for n in (51, 50, 70)]
    more = [(100 + 3 * k + j, f"{prose(rng, 40)}\t{x}\n\n{prose(rng, 25)}") for k, x in enumerate(short) for j in range(3)]
    texts = [(i, t or "") for i, t, *_ in rows] + more + [(200, f"x{short[0]}"), (201, "b " * 120)]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for _, t in texts]
    words = [t.encode().split() for _, t in texts]
    seen_words = Counter(tuple(w[k : k + 51]) for w in words for k in range(len(w) - 50))
    seen = Counter(t.encode()[k : k + 400] for _, t in texts for k in range(len(t.encode()) - 399))
    want, added = Counter(), set()
    for (i, t), at, w in zip(texts, places, words, strict=True):
        b = t.encode()
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                mask[k : k + 400] = True
        before = mask.sum()
        for k in range(len(w) - 50):
            if seen_words[tuple(w[k : k + 51])] > 1:
                mask[at[k][0] : at[k + 50][1]] = True
        if mask.sum() > before:
            added.add(i)
        want[(i, int(mask.sum()), bytes(np.frombuffer(b, np.uint8)[~mask]).decode("utf-8", "ignore"))] += 1
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more + texts[-2:], "doc_id long, text string"))
    got = repeats.remove_repeats(frame, with_text=True, words=51).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept_text) for r in got) == want
    assert {100, 101, 102, 106, 107, 108, 201} <= added and not added & {103, 104, 105, 200}


def test_near_duplicates_against_brute_force(docs, rows, nothing):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), label[i], label[i] == i) for i, s in sets.items()}
    assert near_dup.near_duplicates(nothing).count() == 0


def test_near_duplicates_without_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert {tuple(r) for r in near_dup.near_duplicates(d).collect()} == {(None, 2, None, False), (1, 2, 1, True), (None, 0, None, False)}


def test_signature_keys_find_all_pairs_within_distance():
    """The pigeonhole guarantee: any two signatures within the distance share a key."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, near_dup.SYMBOLS)
        b = a.copy()
        b[rng.choice(near_dup.SYMBOLS, near_dup.DISTANCE, replace=False)] ^= 1
        assert any((a[x:y] != b[x:y]).sum() <= 1 for x, y in zip(near_dup._CUTS, near_dup._CUTS[1:], strict=False))


def test_near_duplicate_families_in_blocks(docs, monkeypatch):
    whole = {tuple(r) for r in near_dup.near_duplicates(docs).collect()}
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    assert {tuple(r) for r in near_dup.near_duplicates(docs).collect()} == whole


def test_one_family_of_thousands_of_near_copies(spark):
    """Copies of one text with one word changed (similarity 0.91 to it, 0.84 to one another), some with a second change (linked to their own source only) and some with four (linked to none)."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]

    def changed(words, i, places):
        return [f"c{i}x{k}" if k in places else w for k, w in enumerate(words)]

    once = [changed(base, i, {rng.randrange(10, 60)}) for i in range(1, 4_401)]
    twice = [changed(once[i], 10_000 + i, {rng.randrange(70, 110)}) for i in range(500)]
    often = [changed(base, 20_000 + i, {12, 40, 70, 100}) for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([base, *once, *twice, *often])], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == {**dict.fromkeys(range(4_901), 0), **{i: i for i in range(4_901, 5_001)}}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60) if i % 20] + [(5, 5), (100, 3), (None, 4)]
    scratch = common.Scratch(spark)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 100: 1, **{i: 21 for i in range(21, 41)}, **{i: 41 for i in range(41, 61)}}
    assert components.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_unit_encoder_equals_the_library(rows, name, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "_MEMO_UNITS", 50)
    enc = tokens.UnitEncoder(public_tokenizers.path(name))
    rng = random.Random(5)
    alphabet = [*"abXYéßñ ,.!?'\"-_%|01\n  你ª²́", "<|endoftext|>", "'s ", "ǅ", "İ", "\t", "\r\n", " "]
    texts = [t for _, t, *_ in rows] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for _ in range(1_500)]
    assert enc.encode(texts) == enc._direct([t or "" for t in texts])


def ids_of(name, text, end=0):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def test_token_store_round_trip(spark, docs, rows, nothing, tmp_path):
    import public_tokenizers

    path, vocabulary = f"file://{tmp_path}/store", public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, path, vocabulary, mean_chunk=32, longest_chunk=100)
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: (r.doc_id, r.start))
    at = 0
    for r, (i, text) in zip(got, sorted([(i, t) for i, t, *_ in rows], key=lambda x: x[0]), strict=True):
        ids = ids_of("byte_bpe_50k.json", text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rebuilt = {(r.doc_id, r.start): r.ids for r in token_store.read_ids(spark, path).collect()}
    assert all(zlib.crc32(np.array(rebuilt[(r.doc_id, r.start)], "<u4").tobytes()) == r.ids_crc32 for r in got)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(r.n_chunks for r in got)
    assert all(r.intact for r in token_store.verify_manifest(spark, path).collect())
    token_store.write_store(nothing, path + "0", vocabulary)
    assert token_store.read_digests(spark, path + "0").count() == 0


def test_packing(docs, rows, nothing):
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, vocabulary).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array(ids_of("word_bpe_49k.json", text), "<u4")
        want.update((i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(nothing, vocabulary).count() == 0


def test_packing_plans_use_every_piece_and_few_sequences():
    from itertools import permutations

    rng = random.Random(4)
    for _ in range(60):
        pieces = [rng.randrange(1, 11) for _ in range(6)]
        plan = packing.plan_patterns(dict(Counter(pieces)), 10)
        assert Counter(x for pattern, n in plan for x in pattern * n) == Counter(pieces) and all(sum(p) <= 10 for p, _ in plan)
        best = 99
        for order in set(permutations(pieces)):
            bins, room = 0, 0
            for x in order:
                if x > room:
                    bins, room = bins + 1, 10
                room -= x
            best = min(best, bins)
        assert sum(n for _, n in plan) <= best + 1


def test_packing_reduction_saves_sequences():
    pieces = Counter([4, 4, 5, 6, 9, 12])  # longest pieces with the longest that fit: (12, 6), (9, 5, 4), (4)
    fixed, rest = packing._reduce(dict(pieces), 20)
    assert fixed == [((9, 6, 5), 1), ((4, 12, 4), 1)] and not rest
    assert sum(n for _, n in packing.plan_patterns(dict(pieces), 20)) == 2
    assert sum(n for _, n in packing._best_fit(dict(pieces), 20)) == 3
    assert packing._reduce({1: 30, 5: 1}, 20) == ([], {1: 30, 5: 1})


def test_packing_best_fit_takes_the_tightest_sequence():
    assert sorted(packing._best_fit({8: 1, 7: 1, 6: 1, 3: 1, 2: 1}, 10)) == [((6,), 1), ((7, 3), 1), ((8, 2), 1)]
    rng = random.Random(8)
    for _ in range(200):
        pieces = [rng.randrange(1, 31) for _ in range(rng.randrange(1, 40))]
        want: list[tuple[int, ...]] = []
        for x in sorted(pieces, reverse=True):
            fits = [k for k, b in enumerate(want) if sum(b) + x <= 30]
            if fits:
                k = max(fits, key=lambda k: sum(want[k]))
                want[k] += (x,)
            else:
                want.append((x,))
        got = packing._best_fit(dict(Counter(pieces)), 30)
        assert Counter(x for p, n in got for x in p * n) == Counter(pieces) and sum(n for _, n in got) == len(want)


def test_html_extraction():
    tree = html_text.trained_tree()
    assert sum(html_text.is_article(x, tree) != bool(y) for x, y in html_text.labelled_table()) <= 5
    page = '<html><head><title>no</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy.</div><article><h1>T &amp; U</h1><p>One<br>two  three<p><b>Bold.</p><div class="comments"><p>Me too.</p></div></article><aside>Also</aside><footer>&copy; x</footer><script>var a="</p>";</script>'
    assert html_text.extract(page, tree) == "T & U\n\nOne two three\n\nBold."
    assert [html_text.extract(x, tree) for x in (None, "", "<nav>x</nav>", "<!-- open", "<script>x")] == [""] * 5


def test_html_tree_uses_words_and_neighbours():
    def used(tree):
        return {html_text.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    found = used(html_text.trained_tree())
    assert {"words", "link density"} <= found and found & {"link density before", "link density after", "words before", "words after"}


def held_out_pages():
    """Layouts that aren't among the training pages; ``data-label`` marks the article."""
    line, mark = html_text._line, 'data-label="1"'
    for n in range(2, 12):
        story = f"<h1 {mark}>{line(6, n)}</h1>" + "".join(f"<p {mark}>{line(x, n + x)}</p>" for x in (18, 33, 5, 51, n + 2)) + f"<blockquote><p {mark}>{line(12, n)}</p></blockquote>"
        menu = html_text._links(6, n)
        yield f'<body><div class="site-header"><div class="logo"><a href="/">{line(2, n)}</a></div><div class="main-nav">{menu}</div></div><div class="layout"><div class="entry-content">{story}</div><div class="ad-slot">{line(10, n)}</div></div><div class="site-footer"><p>{line(9, n)}</p>{menu}</div></body>'
        yield f'<body><div role="navigation">{menu}</div><main id="main"><h2 {mark}>{line(3, n)}</h2>{story}</main><div role="complementary"><p>{line(60, n)}</p></div><div id="comments"><article><p>{line(30, n)}</p></article><article><p>{line(45, n)}</p></article></div></body>'
        yield f'<body><p>{line(7, n)}</p><center>{html_text._links(4, n, "p")}</center><div><div>{story}</div></div><div>{line(14, n)}</div></body>'
        yield f'<body><section class="hero"><p>{line(8, n)}</p></section><section>{story}</section><section class="cta newsletter-signup"><p>{line(11, n)}</p></section><footer>{line(5, n)}</footer></body>'
        yield f'<body><article><div class="title"><h1 {mark}>{line(5, n)}</h1></div><header><p {mark}>{line(4, n)}</p></header><div class="body">{story}</div><footer><p>{line(6, n)}</p></footer></article><nav>{menu}</nav></body>'
        yield f'<body><table><tr><td>{html_text._links(3, n, "p")}</td></tr><tr><td>{story}</td></tr><tr><td><a href="/">{line(3, n)}</a></td><td>{line(4, n)}</td><td><a href="/">{line(2, n)}</a></td></tr></table></body>'
        for name in ("legal-analysis", "tags", "popular-science", "search-story"):
            yield f'<body><div class="{name}">{story}</div><div>{line(9, n)}</div></body>'


def test_html_extraction_of_held_out_layouts():
    tree = html_text.trained_tree()
    right = kept = wanted = 0
    for page in held_out_pages():
        found, parents = html_text.blocks(page)
        for b, x in zip(found, html_text.features(found, parents), strict=True):
            chosen = html_text.is_article(x, tree)
            right += chosen and b.marked
            kept += chosen
            wanted += b.marked
    assert right / kept > 0.97 and right / wanted > 0.95


def test_html_extraction_of_long_pages():
    body = "".join(f"<p>{html_text._line(20, k)}</p>" for k in range(5_000))
    text = html_text.extract(f"<nav><a>x</a></nav><article>{body}</article>" + "<div>" * 3_000, html_text.trained_tree())
    assert len(text.split("\n\n")) == 5_000


def test_html_extraction_of_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", 1), (1, "u", "<article><p>a b</p></article>", 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert sorted(map(str, html_text.extract_text(pages).collect())) == sorted(map(str, [*html_text.extract_text(pages.limit(1)).collect() * 2, *html_text.extract_text(pages.where("html IS NULL")).collect()]))
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_simhash(spark, docs, rows, nothing):
    def column(r):
        return hashlib.sha256(r.encode()).hexdigest()

    got = fingerprints.fingerprint_documents(docs, 4).collect()
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    single = [r for r in got if len(texts[r.doc_id]) == 1]
    order = sorted(texts, reverse=True)
    for r in single:
        after = order[(order.index(r.doc_id) + 1) % len(order)]
        t = texts[r.doc_id][0]
        cut = len(t) // 3
        assert r.n_chars == len(t) and r.edited_sha256 == column(t[: len(t) - cut] + texts[after][0][:cut])
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault(texts[r.doc_id][0], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    assert fingerprints.fingerprint_documents(nothing, 4).count() == 0
    assert fingerprints.fingerprint_documents(docs.where("doc_id = 65").limit(1), 4).first().near_next == 1.0


def test_permuted_tables_find_all_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for x in base for _ in range(6)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    want = {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for k, a in enumerate(signed) for b in signed[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    frame = spark.createDataFrame([(x,) for x in [*signed, signed[0], None]], "fingerprint long")
    assert {tuple(r) for r in fingerprints.near_pairs(frame).collect()} == want and want


def test_permuted_tables_over_fingerprints_of_documents(spark):
    rng = random.Random(12)
    base = prose(rng, 900).split()
    texts = [prose(rng, 60) for _ in range(5)]
    for k in range(30):  # from none to many changed words
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(len(copy))] = f"changed{k}"
        texts.append(" ".join(copy))
    made = fingerprints.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).select("doc_id", "fingerprint")
    made = common.materialize(made, "t")
    prints = sorted({int(r.fingerprint, 16) for r in made.collect()})
    high, low = fingerprints.halves(F.col("fingerprint"))
    for radius, blocks in ((3, 6), (6, 9)):
        want = {frozenset((a, b)): (a ^ b).bit_count() for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= radius}
        got = fingerprints.near_pairs(made.select(high.alias("high"), low.alias("low")), radius, blocks).collect()
        whole = lambda h, x: (h % (1 << 64)) << 64 | x % (1 << 64)
        assert len(got) == len(want) and {frozenset((whole(r.a_high, r.a_low), whole(r.b_high, r.b_low))): r.distance for r in got} == want
    assert any(a >> 64 != b >> 64 and (a ^ b) % (1 << 64) for a, b in want)


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, capped = {}, set()
    while True:  # reshare until none is above
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        want = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / free for s in sizes}
        over = {s for s in sizes if want[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r.mix_target == pytest.approx(want[r.source]) and r.mix_source_size == sizes[r.source] and 0 <= r.mix_taken <= 2 * r.mix_size
        taken[r.source] += r.mix_taken
    assert all(abs(taken[s] - want[s]) < 1.001 for s in sizes)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.mix(nothing).count() == 0
    copies = mixing.training_order(docs).collect()
    expected = Counter({r.doc_id: 0 for r in got})
    for r in got:
        expected[r.doc_id] += sum(r.mix_size > 0 and e * r.mix_source_size + r.mix_before + r.mix_size / 2 <= r.mix_target for e in (0, 1))
    assert Counter(r.doc_id for r in copies) == +expected
    assert [r.mix_position for r in copies] == sorted(r.mix_position for r in copies) and all(0 <= r.mix_position <= 1 for r in copies)


def test_near_counts_against_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(12)]
    prints = [x ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(6))) for x in base for _ in range(8)]
    prints += prints[:10]
    half = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(half(x >> 64), half(x & (1 << 64) - 1)) for x in prints] + [(None, 1)], "high long, low long")
    got = {(r.high, r.low): r.n_near for r in fingerprints.near_counts(frame.limit(40), frame).collect()}
    want = {(half(x >> 64), half(x & (1 << 64) - 1)): sum((x ^ y).bit_count() <= 3 for y in prints) for x in prints[:40]}
    assert got == want and max(want.values()) > 3
    assert fingerprints.near_counts(frame.limit(0), frame).count() == 0


def test_fingerprints_against_plain_votes(spark, docs, rows):
    """Fingerprints and likenesses by counting votes bit by bit, with term hashes from Spark."""
    import math

    made = spark.createDataFrame([(i, t) for i, t, *_ in rows if len(t or "") < 4_000], "doc_id long, text string").dropDuplicates(["doc_id"])
    terms = {r.doc_id: (r.t, r.u) for r in made.select("doc_id", fingerprints.term_hashes(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", "t", F.transform("t", lambda x: F.xxhash64(x, F.lit(1))).alias("u")).collect()}

    def plain(t, u):
        out = 0
        for half, at in ((t, 64), (u, 0)):
            for bit in range(64):
                out |= (2 * sum(h >> bit & 1 for h in half) > len(half)) << (at + bit)
        return out

    want = {i: plain(*x) for i, x in terms.items()}
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(made, 4).collect()}
    assert {i: f"{x:032x}" for i, x in want.items()} == {i: r.fingerprint for i, r in got.items()}
    order = sorted(want, reverse=True)
    for k, i in enumerate(order):
        differ = (want[i] ^ want[order[(k + 1) % len(order)]]).bit_count()
        assert got[i].near_next == pytest.approx(max(0.0, math.cos(math.pi * differ / 128)))
        differ = (want[i] ^ int(got[i].edited_fingerprint, 16)).bit_count()
        assert got[i].near_edited == pytest.approx(max(0.0, math.cos(math.pi * differ / 128)))


def test_mixing_positions_against_brute_force(docs):
    """Each position is where the integral of its source's schedule, summed in small steps, reaches the demand."""
    for r in mixing.mix(docs).where("mix_taken > 0").collect():
        s = mixing.SCHEDULES[r.mix_place % 3]
        steps = [s[0] + (s[1] - s[0]) * 2 * x if x < 0.5 else s[1] + (s[2] - s[1]) * (2 * x - 1) for x in ((k + 0.5) / 20_000 for k in range(20_000))]
        reached = np.searchsorted(np.cumsum(steps) / sum(steps), r.mix_before / max(r.mix_target, 1.0)) / 20_000
        assert r.mix_position == pytest.approx(min(1.0, reached), abs=1e-3)


def test_clashing_columns(spark):
    """Columns named like an operator's own are replaced by it, or kept in the row."""
    data = spark.createDataFrame([(1, "one two three four five six.", "aa", "s", 1, 2, 3, 4)], "doc_id long, text string, lang string, source string, q_l long, lid_lang long, mix_position long, q_text long")
    assert quality.clean_lines(data).columns.count("q_text") == 1 and quality.clean_lines(data).first().q_l == 1
    model = language_id.fit(data)
    assert language_id.identify(data, model).columns.count("lid_lang") == 1
    assert language_id.judge_rows(data, model).select("row.*").first() == data.first()
    assert mixing.training_order(data).columns.count("mix_position") == 1
    assert all(r.row == data.first() for r in mixing.training_rows(data).collect())
    assert mixing.mix(data).columns.count("mix_position") == 1


def test_language_filter_against_exact_sets(spark):
    """Counts from the filter, corrected, against those of the plain sets of n-grams."""
    rng = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi", "ta", "re"], "bb": ["sch", "un", "ber", "ge", "lo"], "cc": ["eau", "ion", "ré", "ka"]}
    data = [(i, " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(60)), x) for i, x in enumerate(rng.choices(sorted(parts), k=120))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    sets = {x: set() for x in parts}
    for r in language_id.learn_grams(docs, 3_000, 0.25)[1].collect():
        sets[r.lang].add(r.gram % (1 << 64))
    for (_, text, _), (name, score, hits, n) in zip(data, model.judge([t for _, t, _ in data]), strict=True):
        found = language_id.grams([text])[0].tolist()
        plain = {x: sum(g in sets[x] for g in found) for x in parts}
        assert n == len(found) and name == max(sorted(plain), key=plain.get)
        assert abs(hits - plain[name]) <= 0.03 * n and abs(score - plain[name] / sum(plain.values())) < 0.05


def test_warc_round_trip(spark, tmp_path):
    inner = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\nWARC/1.0\r\n"
    rows = [("http://a/x", "<title>T</title><p>Hi\r\n\r\nthere <a href='/'>l</a></p>", 1), (None, None, 2), (None, None, 2), ("http://b/", inner, 3), ("http://c/", "<p>" + "long " * 400_000, 4)]
    pages = spark.createDataFrame(rows, "url string, html string, record int").coalesce(1)
    made = common.materialize(warc.responses(pages, "2024-01-01T00:00:00Z"), "t")
    for k, compression in enumerate(("gzip", "none")):
        warc.write_warc(made, f"{tmp_path}/w{k}", compression)
        back = warc.read_warc(spark, f"{tmp_path}/w{k}")
        assert Counter(bytes(r.record) for r in back.collect()) == Counter(bytes(r.record) for r in made.collect())
    derived = warc.derive(back).collect()
    responses = {r.record_id: r for r in made.collect()}
    assert len(responses) == 5 and len({r.record_id for r in derived}) == 10
    assert Counter(r.record_type for r in derived) == {"metadata": 5, "conversion": 5}
    assert all(r.refers_to in responses and responses[r.refers_to].target_uri == r.target_uri for r in derived)
    text = next(bytes(r.record) for r in derived if r.record_type == "conversion" and r.target_uri == "http://a/x")
    assert text.endswith(b"\r\n\r\nHi there l") and warc.digest(b"Hi there l").encode() in text
    assert warc.derive(made.limit(0)).count() == 0
    warc.write_warc(made.limit(0), f"{tmp_path}/none")
    assert warc.read_warc(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="longer"):
        warc._parsed(bytes(made.first().record) + b"more")
