"""Near duplicates, repeated passages, embeddings, chats and the pipeline against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from pointweave.llm import chat, near_dups, repeats
from pointweave.llm import embedding_dups as E
from pointweave.llm.suffixes import common, front_code, merge

from .conftest import EDGES


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), c := least.get(find(k)), i == c if i is not None and c is not None else c is None) for k, (i, _) in enumerate(rows)), key=repr)


def edited(rng, words, share):
    return " ".join(rng.choice(["zz", "yy", w + "q"]) if rng.random() < share else w for w in words)


def near_rows():
    rng = random.Random(5)
    rows, k = list(EDGES), 100
    for _ in range(6):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([8, 30, 200]))]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05):
            rows.append((k, edited(rng, words, share)))
            k += 1
    passage = " ".join(f"p{j}" for j in range(60))
    rows += [(k + j, passage + " " + " ".join(f"u{j}x{m}" for m in range(60))) for j in range(12)]
    return rows


def test_near_duplicates(docs_of):
    rows = near_rows()
    assert sorted(map(tuple, near_dups.near_duplicates(docs_of(rows)).collect()), key=repr) == near_brute(rows)


def chain_rows():
    words = [f"w{j}" for j in range(80)]
    return [(k, " ".join(words[5 * k : 5 * k + 40])) for k in range(8)] + [(50 + k, " ".join(words[:40] + [f"e{k}"] * k)) for k in range(5)]


def test_blocks_find_what_pivots_miss(docs_of, monkeypatch):
    """A chain whose ends are not similar, in blocks of two members."""
    monkeypatch.setattr(near_dups, "BLOCK", 2)
    rows = chain_rows()
    assert sorted(map(tuple, near_dups.near_duplicates(docs_of(rows)).collect()), key=repr) == near_brute(rows)


def hot_rows():
    """One group of which copies differ by up to a third of their words: many are near the threshold with each other."""
    rng = random.Random(21)
    base = [f"w{j}" for j in range(70)]
    rows = [(0, " ".join(base))]
    for k in range(1, 160):
        words, share = list(base), rng.choice([1, 2, 2, 3, 4, 5])
        for j in rng.sample(range(70), share):
            words[j] = rng.choice(["aa", "bb", f"n{k}"])
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 20, "CHUNK": 300, "BROADCAST_IDS": 0}, {"BLOCK_SHINGLES": 500, "BROADCAST_IDS": 0}])
def test_large_group_of_near_copies(docs_of, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dups, name, value)
    rows = hot_rows()
    assert sorted(map(tuple, near_dups.near_duplicates(docs_of(rows)).collect()), key=repr) == near_brute(rows)


def test_links_of_a_block():
    """Every pair of different parts that reaches the threshold is joined by the links that come out, and no other pair."""
    sets = [near_dups.shingles(t) for _, t in hot_rows()]
    n, regs = np.array([len(x) for x in sets]), np.array([near_dups.registers(x) for x in sets])
    at = np.arange(len(sets))
    found = [p for band in range(near_dups.BUCKETS // near_dups.ROWS) for p in near_dups.spanning_links(at, n, regs, sets, at, at, band)]
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in at for b in range(a)}
    linked = {p for p, x in both.items() if 100 * x >= 75 * (n[p[0]] + n[p[1]] - x)}
    assert {(max(p), min(p)) for p in found} <= linked

    def parts(pairs):
        root = at.copy()
        for a, b in pairs:
            root[root == root[a]] = root[b]
        return sorted(sorted(np.flatnonzero(root == r).tolist()) for r in set(root.tolist()))

    shared = {(a, b) for a, b in linked if (regs[a].view(np.int64) == regs[b].view(np.int64)).any()}
    assert parts(found) == parts(shared)


def test_keep_one(docs_of):
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (4, "other words are in this one"), (5, "z z z z z z z"), (5, "z z z z z z z")])
    got = near_dups.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 3, 4, 5]


@pytest.mark.parametrize("broadcast", [None, 0])
def test_keep_one_with_clashing_names(spark, monkeypatch, broadcast):
    if broadcast is not None:
        monkeypatch.setattr(near_dups, "BROADCAST_IDS", broadcast)
    names = ["doc_id", "text", "_i", "_t", "_row", "_d", "_h", "node", "a.b", "component", "spans"]
    docs = spark.createDataFrame([(k, t, *"xyzuvwpqr") for k, t in [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)]], f"doc_id long, text string, {', '.join(f'`{c}` string' for c in names[2:])}")
    got = near_dups.keep_one(docs)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d e f", *"xyzuvwpqr"), (3, None, *"xyzuvwpqr")]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    for n in (5, 60, 900):
        errors = []
        for _ in range(60):
            h = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(h[: int(1.6 * n)]), np.unique(h[int(0.4 * n) :])
            true = len(np.intersect1d(a, b)) / len(h)
            errors.append(near_dups.estimate(near_dups.registers(a)[None], near_dups.registers(b)[None], np.array([len(a) * 1.0]), np.array([len(b) * 1.0]))[0] - true)
        assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.06


def test_candidates_are_not_lost_by_the_estimate():
    equal = range(int(near_dups.BUCKETS * near_dups.LEAST) + 1)
    loss = sum(math.comb(near_dups.BUCKETS, k) * 0.75**k * 0.25 ** (near_dups.BUCKETS - k) for k in equal)
    assert loss < 1e-7  # far below the banding's 5e-6


def test_loser_tree():
    rng = random.Random(3)
    for _ in range(150):
        runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"%d" % k) for k in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 9))]
        before, got = b"", list(merge([front_code(r) for r in runs]))
        assert [s for _, s, _ in got] == sorted(s for r in runs for s, _ in r)
        for shared, s, _ in got:
            assert shared == common(before, s, 0)
            before = s


def repeat_brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((rows[k][0], len(raw), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(90, 400))) for _ in range(8)]
    rows = []
    for k in range(60):
        parts = [rng.choice([rng.choice(base)[rng.randint(0, 60) : rng.randint(100, 400)], "".join(rng.choice("abc dé") for _ in range(rng.randint(0, 80))), "x" * rng.randint(0, 150)]) for _ in range(rng.randint(0, 6))]
        rows.append((k, "".join(parts)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_ROWS": 0}, {"RUN": 50, "PART": 20}, {"equal_by_hash": True}])
def test_repeats(docs_of, monkeypatch, limits):
    """Also with every join by a shuffle, with short runs, and with equal surroundings settled by their hash anywhere."""
    by_hash = limits.get("equal_by_hash", False)
    for name, value in limits.items():
        if name != "equal_by_hash":
            monkeypatch.setattr(repeats, name, value)
    rows = repeat_rows()
    assert sorted(map(tuple, repeats.dedup_repeats(docs_of(rows), by_hash).collect()), key=repr) == repeat_brute(rows)


def test_rows_settled_before_the_exchange():
    rng = np.random.default_rng(2)
    h, around, shape, order = (rng.integers(0, k, 400) for k in (9, 3, 2, 10**6))
    first = {}
    for k in np.argsort(order, kind="stable"):
        first.setdefault((h[k], around[k], shape[k]), k)
    got = repeats._repeats_here(h, around, shape, order)
    assert sorted(np.flatnonzero(~got)) == sorted(first.values())


def test_repeats_on_edges(docs_of):
    long = "".join(hashlib.sha512(c).hexdigest() for c in (b"a", b"b"))[:150]
    rows = [(i, t) for i, t in EDGES if i != 9] + [(60, long), (60, long), (61, long + "é" * 70), (None, "n" * 120)]
    got = sorted(map(tuple, repeats.dedup_repeats(docs_of(rows)).collect()), key=repr)
    want = repeat_brute(rows)
    assert got == want
    assert repeats.dedup_repeats(docs_of([])).count() == 0


def test_strip_repeats(docs_of):
    long = "".join(hashlib.sha512(c).hexdigest() for c in (b"a", b"b"))[:150]
    docs = docs_of([(1, long), (1, long), (2, "head é " + long + " tail"), (3, long), (4, None), (4, None), (5, "short")])
    got = repeats.strip_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=repr) == sorted([(1, long, 150), (2, "head é  tail", 12), (4, None, None), (4, None, None), (5, "short", 5)], key=repr)


@pytest.mark.parametrize("broadcast", [None, 0])
def test_strip_repeats_with_clashing_names(spark, monkeypatch, broadcast):
    if broadcast is not None:
        monkeypatch.setattr(repeats, "BROADCAST_ROWS", broadcast)
    long = "".join(hashlib.sha512(c).hexdigest() for c in (b"a", b"b"))[:150]
    names = ["spans", "_i", "_x", "_d", "_h", "_v", "copies", "_doc", "a.b", "version"]
    docs = spark.createDataFrame([(k, t, *names) for k, t in [(1, long), (1, long), (2, "head " + long), (3, None), (4, "x")]], f"doc_id long, text string, {', '.join(f'`{c}` string' for c in names)}")
    got = repeats.strip_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, long, *names), (2, "head ", *names), (3, None, *names), (4, "x", *names)], key=repr)


def vector_brute(rows):
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in fine:
        for b in fine:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                    links[a] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((i, links[k], c := min(rows[m][0] for m in range(len(rows)) if find(m) == find(k)), i == c) for k, (i, _) in enumerate(rows)), key=repr)


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for _ in range(25):
        middle = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((k, (middle + rng.normal(0, 0.15, 16)).tolist()))
            k += 1
    rows += [(k, rows[0][1]), (k + 1, rows[0][1]), (k + 2, None), (k + 3, []), (k + 4, [0.0] * 16), (k + 5, [float("nan")] * 16), (k + 6, [None, 1.0]), (k + 7, [1.0, 2.0]), (k + 8, [2.0, 4.0]), (k + 9, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, node int")
    got = sorted(map(tuple, E.near_duplicate_vectors(df).collect()), key=repr)
    assert got == vector_brute(rows)
    assert E.near_duplicate_vectors(df.limit(0)).count() == 0


def grouped_vectors(seed, pairs=30, large=90):
    """A large group, many pairs, and vectors alone."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=16)
    rows = [(k, (middle + rng.normal(0, 0.05, 16)).tolist()) for k in range(large)]
    for _ in range(pairs):
        middle = rng.normal(size=16)
        rows += [(len(rows) + j, (middle + rng.normal(0, 0.05, 16)).tolist()) for j in range(2)]
    rows += [(len(rows) + j, rng.normal(size=16).tolist()) for j in range(150)]
    rows += [(len(rows) + 50, rows[0][1]), (len(rows) + 51, rows[0][1])]
    return rows


@pytest.mark.parametrize("limits", [{"SHARD": 40, "CAP": 30}, {"SHARD": 12, "MOST_SHARDS": 4, "FOR_CENTRE": 12, "CHUNK": 50}])
def test_links_in_many_shards(spark, monkeypatch, limits):
    """Blocks and two levels of centres: the search alone reaches the audit's target, and no link is counted twice."""
    for name, value in limits.items():
        monkeypatch.setattr(E, name, value)
    monkeypatch.setattr(E, "ASKED", 1)
    rows = grouped_vectors(4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    _, nodes = E._nodes(df)
    found = E.find_links(nodes, nodes.count())
    least = E.recall(nodes, found)
    assert least >= 0.95
    want = {i: n for i, n, *_ in vector_brute(rows)}
    monkeypatch.setattr(E, "all_links", lambda nodes, n, cosine: (found, least))
    got = {i: n for i, n, *_ in E.near_duplicate_vectors(df).collect()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.95 * sum(want.values())


def test_lost_small_groups_are_found(spark, monkeypatch):
    """A search that keeps the large group only, in every attempt, ends in the exact comparison."""
    monkeypatch.setattr(E, "STRIP", 40)
    monkeypatch.setattr(E, "ASKED", 1)
    rows = grouped_vectors(6, 20, 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def lossy(nodes, n, *_):
        links = E.exact_links(nodes, n)
        return E.cut(links.join(links.where("n > 5").select(E.F.col("node").alias("k")).distinct(), E.F.col("node") == E.F.col("k")).drop("k"))

    monkeypatch.setattr(E, "find_links", lossy)
    assert sorted(map(tuple, E.near_duplicate_vectors(df).collect()), key=repr) == vector_brute(rows)


def test_range_search_recall():
    rng = np.random.default_rng(3)
    x = E.unit(np.repeat(rng.normal(size=(60, 32)), 10, axis=0) + rng.normal(0, 0.2, (600, 32)))
    lists = E.robust_prune(x)
    width = max(map(len, lists))
    neighbours = np.array([np.pad(n, (0, width - len(n)), constant_values=-1) for n in lists])
    hits = E.range_search(x, neighbours, x, E.medoids(x, 8))
    true = x @ x.T >= 0.9
    assert (true & hits).sum() >= 0.95 * true.sum()
    assert not (hits & (x @ x.T < E.SLACK - 1e-9)).any()


def test_forest_and_numbers_of_links():
    found = E.Found(np.array([1, 2, 1, 5, 1, 1]))
    found.add(np.array([0, 1, 4]), np.array([1, 2, 5]))
    found.add(np.array([0]), np.array([2]))
    rows = found.batch(np.arange(6) * 10).to_pylist()
    assert [(r["node"], r["n"], r["w"]) for r in rows if r["other"] is None] == [(0, 2, 3), (10, 2, 2), (20, 2, 3), (40, 1, 1), (50, 1, 1)]
    assert [(r["node"], r["other"]) for r in rows if r["n"] is None] == [(10, 0), (20, 0), (50, 40)]


def test_chat(spark):
    talk = [("user", "hi"), ("assistant", "hello <|end|>"), ("user", None), (None, "bye")]
    rows = [(1, k, *t) for k, t in enumerate(talk[:1])] + [(2, k, *t) for k, t in enumerate(talk[:3])] + [(3, k, *t) for k, t in enumerate(talk)] + [(4, k, *t) for k, t in enumerate(talk)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (5, 1, "assistant", "other"), (None, 0, "user", "x"), (6, None, "user", "no turn")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, h1 int")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert sorted(got) == [3, 5, 6]
    assert (got[3]["n_turns"], got[3]["n_copies"], got[5]["n_turns"]) == (4, 2, 2)
    assert got[3]["rendered"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello < |end|>\n<|end|>\n<|user|>\n\n<|end|>\n<|unknown|>\nbye\n<|end|>"
    assert chat.format_chats(df.limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", chat.format_chats(df)._jdf.queryExecution().toString())


def chats_brute(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, set()).add((turn is not None, turn or 0, role if role is not None else "unknown", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    talks = {c: tuple((role, text) for _, _, role, _, text in sorted(turns)) for c, turns in found.items()}
    proper = {t[:k] for t in talks.values() for k in range(1, len(t))}
    safe = lambda x: x.replace("<|", "< |")
    return sorted((min(c for c in talks if talks[c] == t), len(t), sum(x == t for x in talks.values()), "\n".join(f"<|{safe(r)}|>\n{safe(x)}\n<|end|>" for r, x in t)) for t in set(talks.values()) if t not in proper)


def test_chat_against_brute_force(spark):
    """Snapshots, ties of turn and role in any order of rows, and one conversation of 20,000 turns with a snapshot of half of it."""
    rng = random.Random(12)
    rows = []
    for c in range(60):
        length = rng.randint(1, 6)
        rows += [(c, k // 2 if c % 3 else k, rng.choice(["user", "assistant", None]) if c % 5 == 0 else "user", f"t{rng.randint(0, 2)}") for k in range(length)]
    rows += [(100, k, "user", f"long {k}") for k in range(20_000)] + [(101, k, "user", f"long {k}") for k in range(10_000)]
    rng.shuffle(rows)
    got = sorted(map(tuple, chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert got == chats_brute(rows)


def test_chat_equals_its_sql(spark):
    import duckdb
    import pandas as pd

    rows = [(c, t, r, x) for c in range(4) for t in (0, 0, 1) for r in ("a", "b") for x in ("x", f"y{c % 2}", "<|z")] + [(9, None, None, None)]
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    want = con.execute(chat.ORACLE).fetchall()
    assert sorted(map(tuple, chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())) == sorted(want)


@pytest.fixture(scope="module")
def small_folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "ri") for b in ("mel", "tan", "sou", "vi") for c in ("a", "en", "o", "st")]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, labels = [], []
    for k in range(60):
        body = " ".join(rng.choice(words) for _ in range(120))
        rows.append((k, body + (" " + passage if k % 10 == 0 else "")))
        labels.append((k, 1, 0))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    for k in range(30):
        rows.append((200 + k, " ".join(rng.choice(words).upper() + rng.choice(["###", "$$$", "!!"]) for _ in range(80))))
        labels.append((200 + k, 0, 0))
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_pipeline(spark, small_folder):
    import corpus_pipeline as P

    from .test_tokens import check_packing

    folder, rows = small_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:2]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i, _ in rows if i < 200}
    # from here on every step has a plain counterpart
    left = [(i, t) for i, t in rows if i in kept and i < 100]
    seen, stripped = set(), []
    for i, t in left:
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        stripped.append((i, bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode()))
    check_packing(P.run(spark, folder).collect(), stripped)


def test_pipeline_without_rows(spark, small_folder, tmp_path):
    import corpus_pipeline as P

    for t in ("documents", "labels"):
        spark.read.parquet(f"{small_folder[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("overlap", [E.OVERLAP, 2 * E.OVERLAP])
def test_shards_of_vectors_are_one_block_as_a_rule(spark, overlap):
    x = np.random.default_rng(3).normal(size=(6000, 8))
    nodes = E.cut(spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "node long, copies long, embedding array<double>"))
    sizes = [r["count"] for r in E._homes(nodes, len(x), overlap, 7).select(E.F.explode("home").alias("shard")).groupBy("shard").count().collect()]
    assert sum(sizes) == overlap * len(x)
    assert np.median(sizes) <= E.CAP
