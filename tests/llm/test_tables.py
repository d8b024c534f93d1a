"""Near-duplicate texts and vectors, archives, components and the pipeline against brute force and at the edges."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from inkloom.llm import archives, flatgraph, graphs, leaks, minmax
from inkloom.llm.store import new_path

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes(items, linked):
    """Least member reachable by links, by repeated passes."""
    root = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if root[a] != root[b] and linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def near_copies(rng, n):
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    rows, base = [], [[word() for _ in range(rng.choice([4, 30, 60]))] for _ in range(6)]
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = word()
        rows.append((i, rng.choice([" ", "  ", "\t", "\n"]).join(own) if i % 5 else " ".join(own).upper()))
    return rows


@pytest.mark.parametrize("k,percent,block", [(3, 85, 512), (3, 85, 4), (5, 80, 8)])
def test_near_duplicates_equal_brute_force(frame, monkeypatch, k, percent, block):
    monkeypatch.setattr(minmax, "BLOCK", block)
    rows = near_copies(random.Random(k + block), 120) + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "a b")]
    sets = {i: shingles(t, k) for i, t in rows}
    linked = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    want = classes(list(sets), linked)
    out = minmax.near_duplicates(frame(rows), k=k, percent=percent).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
        assert r["kept"] == r["chosen"] == (r["doc_id"] == r["component_id"])


def test_near_duplicate_edges(frame):
    df = frame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (5, None)]).withColumnRenamed("lang", "node")
    out = minmax.near_duplicates(df, with_text=True).collect()
    by_text = {t: [r for r in out if r["text"] == t] for t in ("a b c d", "x y z", None)}
    assert {r["component_id"] for r in by_text["a b c d"]} == {1} and sum(r["chosen"] for r in by_text["a b c d"]) == 1
    assert [(r["component_id"], r["kept"], r["chosen"]) for r in by_text["x y z"]] == [(None, True, True)]
    assert [(r["n_shingles"], r["component_id"], r["chosen"]) for r in by_text[None]] == [(0, 5, True)]
    assert minmax.near_duplicates(df.limit(0)).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    a, b = minmax.signature(np.sort(x[:5500]), 512), minmax.signature(np.sort(x[500:]), 512)
    assert abs((a == b).mean() - 5000 / 6000) < 0.05
    assert (minmax.signature(x[:1], 8)[:8] == minmax.signature(x[:1], 8)[8:]).all()


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    out = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert graphs.components(spark.createDataFrame([], "a int, b int")).collect() == []


def vectors(rng, n, dim=16):
    base = rng.normal(size=(n // 10, dim))
    rows = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dim)) * rng.choice([0, 0.05, 0.1], (n, 1))
    return (rows * rng.uniform(0.5, 3, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("target,limit", [(1500, 4096), (40, 4096), (60, 50)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, target, limit):
    monkeypatch.setattr(flatgraph, "TARGET", target)
    monkeypatch.setattr(flatgraph, "LIMIT", limit)
    rng = np.random.default_rng(target + limit)
    data = vectors(rng, 400)
    labels = rng.integers(0, 2, 400).tolist()
    rows = [(i, v.tolist(), label) for i, (v, label) in enumerate(zip(data, labels, strict=True))]
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], None), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0),
             (1005, [None] + [1.0] * 15, 0), (1006, [1.0, 2.0], 0), (1007, [float("inf")] + [0.0] * 15, 0), (1008, [], 0), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    out = flatgraph.near_vectors(df, overlap=2).collect()
    assert len(out) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows
            if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    near = lambda x, y: x[2] == y[2] and len(x[1]) == len(y[1]) and cos(x[1], y[1]) >= 0.98
    root, count = {}, {}
    for x in good:
        count.setdefault(x[0], sum(near(x, y) for y in good) - 1)
    index = {k: x for k, x in enumerate(good)}
    parent = classes(list(index), lambda a, b: near(index[a], index[b])) if target == 60 else None
    for r in out:
        assert r["n_links"] == count.get(r["vec_id"], 0), r
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        if parent:
            root = {k: min(index[m][0] for m in index if parent[m] == parent[k]) for k in index}
            own = [root[k] for k, x in index.items() if x[0] == r["vec_id"]]
            assert r["component_id"] == (own[0] if own else r["vec_id"])
    assert flatgraph.near_vectors(df.limit(0)).collect() == []


def test_robust_pruning_drops_what_a_kept_neighbour_covers():
    u = flatgraph.unit(np.array([[1, 0], [1, 0.1], [1, 0.12], [1, -0.3]]))
    assert flatgraph.robust_prune(u, np.array([0]), np.array([[1, 2, 3]]), 3).tolist() == [[1, 3, -1]]


def pages(spark):
    big = "é" * 600
    rows = [(1, "http://a/é x", big), (2, None, big), (7, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
            (None, "u", big), (None, "u", "y" * 1200), (8, "u", "z" * 300_000), (9, "u", "q" * 1500), (9, "u", "q" * 1500)]
    rows += [(100 + i, f"u{i}", f"{i} " * 700) for i in range(300)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(archives, "FRAME_BYTES", 50_000)
    rows, df = pages(spark)
    folder = new_path(spark, "archives")
    index = archives.write_archives(df, folder)
    out = archives.read_archives(index, folder).collect()
    assert len(out) == len(rows)
    stored = {}
    for r in out:
        stored.setdefault((r["page_id"], r["payload_digest"]), []).append(r)
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        last = max(same, default=None)
        revisit = len(data) >= 1000 and last is not None and page != last
        for r in stored[page, hashlib.sha1(data).hexdigest()]:
            assert r["payload_bytes"] == len(data)
            assert (r["record_type"], r["refers_to"]) == (("revisit", last) if revisit else ("response", None))
            assert r["payload"] == (None if revisit else data)
    wanted = index.where("record_id IN ('urn:page:1', 'urn:page:7', 'urn:page:8')")
    fetched = {r["record_id"]: next(archives.parse_records(bytes(r["record"]))) for r in archives.fetch_records(index, folder, wanted).collect()}
    assert fetched["urn:page:7"][6] == ("é" * 600).encode() and fetched["urn:page:1"][5] == "7" and fetched["urn:page:8"][3] == 300_000
    empty = new_path(spark, "archives")
    assert archives.read_archives(archives.write_archives(df.limit(0), empty), empty).collect() == []


def test_bundles_are_plain_zstandard_with_a_seek_table(spark):
    import io

    import zstandard
    from pyarrow import fs

    _, df = pages(spark)
    folder = new_path(spark, "archives")
    name = archives.write_archives(df, folder).first()["file"]
    store, path = archives._store(folder)
    with store.open_input_file(f"{path}/{name}") as handle:
        data = handle.read()
        frames = archives.read_seek_table(handle)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and isinstance(store, fs.FileSystem)
    assert b"".join(zstandard.ZstdDecompressor().decompress(data[a:a + n]) for a, n in frames) == plain


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "on", "su"]) for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        own = [word() for _ in range(60)]
        if i % 5 == 0:
            own.insert(9, rng.choice(["vexling", "grobnar"]))
        rows.append((i, " ".join(own), "en", f"s{i % 4}", 0))
        labels.append((i, 0, int(i % 5 == 0)))
    item = " ".join(word() for _ in range(30))
    rows += [(1001, rows[1][1] + " " + word(), "en", "s0", 0), (1002, item + " and more", "en", "s0", 0),
             (1003, rows[2][1] + " x password = abcdef123456", "en", "s1", 0), (1004, None, "en", None, None), (1, rows[1][1], "en", "s1", 0)]
    for name, data, schema in (("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
                               ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", [(1, item)], "item_id bigint, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)).cache())
    ids = [sorted(r["doc_id"] for r in df.select("doc_id").collect()) for df in seen]
    assert all(df.columns == docs.columns for df in seen[:-1])
    assert ids[1] == [i for i in ids[0] if i % 5 or i >= 1000]
    assert ids[2] == [i for i in sorted(set(ids[1])) if i not in (1001, 1003)]
    assert ids[3] == [i for i in ids[2] if i != 1002] and ids[4] == ids[3]
    assert 0 < len(ids[5]) <= len(ids[4])
    texts = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert all(not leaks.find(r["text"] or "") and (r["text"] == texts[r["doc_id"]] or "[" in r["text"]) for r in seen[4].collect())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, seen[5].collect()))


def test_rounds_over_few_links_write_few_files(spark, monkeypatch):
    """A round's tables hold a file per ROWS rows that they can have, however many partitions a shuffle has."""
    files, plain = {}, graphs.written

    def counted(df, name):
        table = plain(df, name)
        files.setdefault(name, []).append(len(table.inputFiles()))
        return table
    monkeypatch.setattr(graphs, "written", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i - 1) for i in range(1, 60) if i % 20], "a int, b int")
        out = {r["node"]: r["component"] for r in graphs.components(links).collect()}
        few = files.copy()
        monkeypatch.setattr(graphs, "ROWS", 20)
        files.clear()
        assert {r["node"]: r["component"] for r in graphs.components(links).collect()} == out
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == {i: i - i % 20 for i in range(60)}
    assert max(few["least"]) == 1 and max(few["links"][1:]) == 1
    assert max(files["least"]) > 1 and max(files["links"][1:]) > 1
