"""Operators 11 to 13 against brute force on small rows: nulls, ties, repeated rows, empty tables, long texts, other columns with clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import rows as plain_rows
from veritrail.llm import catalog, divergence, infill, vectors

VECTORS = "vec_id long, embedding array<float>, label int, n_links long, node string"


def linked_by_hand(rows, threshold=0.95, kind=np.float32):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    wide = [np.asarray(np.asarray(v, kind), np.float64) if ok else None for (_, v), ok in zip(rows, good)]
    near = [[j for j in range(len(rows)) if i != j and good[i] and good[j] and len(wide[i]) == len(wide[j]) and wide[i] @ wide[j] / (np.sqrt(wide[i] @ wide[i]) * np.sqrt(wide[j] @ wide[j])) >= threshold] for i in range(len(rows))]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((vec_id, len(near[i]), min(ids, default=None), vec_id is not None and vec_id == min(ids)))
    return Counter(out)


def hard_vectors(seed, spread):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(12):  # groups of near copies about a centre, some within the threshold
        centre = rng.normal(size=16)
        rows += [(None, (centre + rng.normal(size=16) * spread).tolist()) for _ in range(10 + 15 * (k % 3))]
    rows += [(None, rng.normal(size=16).tolist()) for _ in range(120)]
    rows += [(None, [1.0] + [0.0] * 15)] * 4 + [(None, [2.0] + [0.0] * 15), (None, [-3.0] + [0.0] * 15), (None, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [1.0])]
    rows = [(10_000 - 7 * i, v) for i, (_, v) in enumerate(rows)]
    rows += [(5, None), (6, []), (7, [0.0] * 16), (8, [1.0, None] + [0.0] * 14), (9, [float("nan")] * 16), (10, [float("inf")] + [0.0] * 15), (-3, rows[0][1]), (rows[3][0], rows[60][1]), (None, rows[5][1]), (None, rows[5][1]), (None, [1e30, -1e30] * 8), (None, None)]
    return rows


@pytest.mark.parametrize(("block", "spread"), [(16, 0.1), (64, 0.25), (8_192, 0.18)])
def test_range_join_against_all_pairs(spark, monkeypatch, block, spread):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = hard_vectors(block, spread)
    frame = spark.createDataFrame([(i, v, 1, 9, "clash") for i, v in rows], VECTORS).repartition(3)
    got = Counter(tuple(r) for r in vectors.near_vectors(frame).collect())
    assert got == linked_by_hand(rows)
    assert sum(k[1] > 0 for k in got) > 50


def test_range_join_at_the_threshold_and_in_low_dimensions(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))]  # here bounds prune much, and chains are long
    rows += [(1_000, [3.0, 4.0, 0.0]), (1_001, [4.0, 3.0, 0.0])]  # a cosine of 0.96 exactly
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in vectors.near_vectors(frame, 0.96).collect()) == linked_by_hand(rows, 0.96, np.float64)
    assert {r.vec_id: r.n_links for r in vectors.near_vectors(frame.where("vec_id >= 1000"), 0.96).collect()} == {1_000: 1, 1_001: 1}


def test_range_join_of_nothing(spark):
    nothing = spark.createDataFrame([], VECTORS)
    assert vectors.near_vectors(nothing).count() == 0
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(1, [0.0], 1, 1, "")], VECTORS)).collect()] == [(1, 0, 1, True)]


def test_pivots_keep_apart():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=8) + rng.normal(size=(200, 8)) * 0.01
    sample = np.vstack([dense, rng.normal(size=(50, 8))])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = vectors.choose_pivots(sample, 20, 0.63)
    gaps = vectors._distances(chosen, chosen) + 9 * np.eye(len(chosen))
    assert len(chosen) > 5 and gaps.min() > 0.63


def test_skip_list_places():
    rng = np.random.default_rng(2)
    for n in (0, 1, 31, 32, 33, 1_024, 1_025, 40_000):
        lengths = rng.integers(1, 9, n)
        lanes, ends = infill.SkipList(lengths), np.concatenate([[0], np.cumsum(lengths)])
        assert all(lanes.place(int(k)) == ends[k] for k in {0, n, *rng.integers(0, n + 1, 200).tolist()})
    with pytest.raises(IndexError):
        infill.SkipList(np.ones(3)).place(4)


def infill_by_hand(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, sha(out), sha(text)


def hard_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab <>PSM\n\té你😀", k=rng.randrange(0, 90))) for _ in range(300)]
    texts += [None, "", "x", "a<P>b", "<S>", "<M", "<", ">P>", "é" * 50, "ß你😀 " * 700_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id"), (None, None), (-5, "minus")]
    return rows


def test_fill_in_middle_against_brute_force(spark, tmp_path):
    rows = hard_texts()
    frame = spark.createDataFrame([(i, t, "kept", 7, "old") for i, t in rows], "doc_id long, text string, n string, form int, FIM_form string").repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in infill.op12_fill_in_middle(spark, str(tmp_path)).collect())
    assert got == Counter(infill_by_hand(*r) for r in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    whole = infill.fill_in_middle(frame)
    assert whole.columns[:4] == ["doc_id", "text", "n", "form"] and "FIM_form" not in whole.columns
    assert Counter((r.doc_id, r.text, r.n) for r in whole.collect()) == Counter((i, t, "kept") for i, t in rows)
    assert infill.fill_in_middle(frame.where("false")).count() == 0


def test_fill_in_middle_by_words(spark):
    rows = [(i, " ".join(["una", "palabra", "más"] * (i % 7 + 1))) for i in range(60)]
    made = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"\S+\s*").withColumn("again", infill.restored(F.col("fim_output"), F.col("fim_form"))).collect()
    for r in made:
        assert r.again == r.text and r.fim_n_units == len(r.text.split())
        if r.fim_form != "plain":
            starts = {0, len(r.text), *(m.start() for m in re.finditer(r"\S+", r.text))}
            assert {r.fim_prefix_chars, r.fim_prefix_chars + r.fim_middle_chars} <= starts


def audit_by_hand(rows):
    docs = [(la or "", so or "", re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for la, so, t in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= 3}
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for a in counts:
            pairs = [(b, sum((share(counts[a], t) - share(counts[b], t)) ** 2 // share(counts[b], t) for t in kept)) for b in counts if b != a]
            terms = [(t, (share(counts[a], t) - share(whole, t)) ** 2 // share(whole, t)) for t in kept if counts[a][t] and share(counts[a], t) > share(whole, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or k <= 200:
                        out[lang, a, part, item, value, k] += 1
    return out


def corpus(seed, sources):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghéßñ你", k=rng.randrange(1, 6))) for _ in range(900)]
    rows = []
    for lang, share in (("en", 0.6), ("de", 0.3), (None, 0.1)):
        for _ in range(int(share * 400)):
            s = rng.randrange(sources)
            rows.append((lang, None if s == 0 else f"s{s}", " ".join(w.title() if rng.random() < 0.2 else w for w in rng.choices(words[s * 5 : s * 5 + 500], k=rng.randrange(0, 60)))))
    return rows + [("en", "bare", None), ("en", "blank", " 12 %\n"), ("xx", "a", "one two"), ("xx", "b", None), ("yy", "only", "w w w"), ("en", "s1", "çok " * 30_000), (None, None, None)] + [rows[0]] * 3


@pytest.mark.parametrize(("sources", "tile_rows", "tile_columns"), [(6, 64, 4_096), (23, 5, 60)])
def test_audit_against_brute_force(spark, monkeypatch, sources, tile_rows, tile_columns):
    monkeypatch.setattr(divergence, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(divergence, "TILE_COLUMNS", tile_columns)
    rows = corpus(sources, sources)
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, source string, text string, value long, term string").repartition(3)
    got = Counter(tuple(r) for r in divergence.audit(frame).collect())
    assert got == audit_by_hand(rows)
    assert divergence.audit(frame.where("false")).count() == 0


def test_trees_meet(monkeypatch):
    rng = np.random.default_rng(3)
    for rows, other, width in ((1, 1, 1), (8, 9, 33), (37, 5, 700), (64, 64, 1_000)):
        trees, dense = [], []
        for n in (rows, other):
            empty = rng.integers(1, 9, n)
            cells = np.unique(np.stack([rng.integers(0, n, 40), rng.integers(0, max(1, width // 3), 40)], 1), axis=0)
            shares = rng.integers(1, 10**6, len(cells))
            full = np.repeat(empty[:, None], width, 1)
            full[cells[:, 0], cells[:, 1]] = shares
            trees.append(divergence.QuadTree(empty, width, cells[:, 0], cells[:, 1], shares))
            dense.append(full)
        assert (divergence.divergence(*trees) == divergence.price(dense[0][:, None], dense[1][None]).sum(2)).all()


@pytest.mark.parametrize("name", ["op11_embedding_range_join", "op12_fill_in_middle", "op13_source_divergence"])
def test_queries_match_sql(spark, name):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, folder).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain_rows(ours) == plain_rows(theirs) and len(ours)


def test_scratch_sets_rows_of_a_batch_back(spark):
    from veritrail.llm.common import Scratch

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), Scratch(spark, batch=7):
        assert spark.conf.get(name) == "7"
        raise ValueError
    assert spark.conf.get(name) == before
