"""Prefix tries and periodic runs against plain forms of their contracts."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabularium.llm import queries, runs, trie

CONVERSATIONS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(number):
    return zlib.crc32(str(number).encode())


# ---- prefix tries


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = own + sum(saved[c] for c in children[node])
    out = set()
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(convs[c]) == len(node))))
        out.add((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]), leaves[node], saved[node], sha(ends)))
    return out


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c in own:
        h, base = crc(c) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def nodes(df):
    rows = [tuple(r[c] for c in NODE) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def written(spark, tmp_path, rows, schema=CONVERSATIONS, name="conversations"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_trie_of_the_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op11_prefix_trie(spark, sf_dir)) == plain_trie(plain_rebuilt(rows))


def test_trie_of_few_turns_in_many_conversations(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in [*range(-7, 900), 10**15, 10**15 + 3]:
        if c % 15 == 10:
            continue  # some bases are absent
        rows += [(c, t, rng.choice(["user", "system"]) if t else "user", rng.choice("ab") if t else "hi") for t in range(rng.randrange(1, 9))]
    rows += [(50, None, None, None), (50, 0, "user", "tie"), (50, 0, "user", "tie"), (50, 0, "assistant", None), (None, 0, "user", "lost"), (51, 3, "ü", "long " * 20_000)]
    assert nodes(queries.op11_prefix_trie(spark, written(spark, tmp_path, rows))) == plain_trie(plain_rebuilt(rows))


def test_trie_of_long_conversations_and_turnless_ones(spark):
    convs = {1: [("u", str(i % 7)) for i in range(2500)], 2: [("u", str(i % 7)) for i in range(2500)], 3: [], 4: [("u", "0")], 5: [("u", str(i % 7)) for i in range(1500)] + [("u", "x")] * 9}
    rows = [(c, t, role, text) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    turns = trie.ordered(spark.createDataFrame(rows, CONVERSATIONS).withColumn("extra", F.lit(1)))
    sizes = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, n_turns long")
    assert nodes(trie.prefix_trie(turns.join(sizes, "conv_id"), sizes)) == plain_trie(convs)


def test_trie_of_nothing_one_and_copies(spark, tmp_path):
    for rows in ([], [(7, 0, "user", "alone")], [(c, 0, "user", "same") for c in range(40)], [(c, t, "u", "s") for c in (5, 6) for t in range(12)]):
        assert nodes(queries.op11_prefix_trie(spark, written(spark, tmp_path, rows))) == (plain_trie(plain_rebuilt(rows)) if rows else set())


def test_turns_are_numbered_over_ranges(spark):
    rows = [(1, t, "u", str(t)) for t in range(3000)] + [(2, t, "u", "x") for t in range(5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.ordered(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.place for r in got if r.conv_id == 1) == list(range(3000)) and sorted(r.place for r in got if r.conv_id == 2) == list(range(5))


def test_queue_spills_and_totals_hold():
    rng = random.Random(1)
    parent = {0: None, **{i: rng.randrange(max(0, i - 40), i) for i in range(1, 3000)}}
    depth = {0: 1}
    for i in range(1, 3000):
        depth[i] = depth[parent[i]] + 1
    rows = sorted(((i, 0, parent[i] or 0, 0, depth[i], 0, 0, i, 0, 0, 0) for i in parent), key=lambda r: (-r[4], r[0]))
    expected = {i: [0, i, 0] for i in parent}
    for i in sorted(parent, key=depth.get, reverse=True):
        expected[i][0] = expected[i][0] or 1
        if i:
            for k, v in enumerate((expected[i][0], expected[i][1], 1)):
                expected[parent[i]][k] += v
    for most in (5, 1 << 18):
        assert {r[0]: list(r[5:]) for r in trie.time_forward(rows, most)} == expected
    queue = trie.SpillingQueue(2, 4)
    entries = [(rng.randrange(50), i) for i in range(333)]
    for e in entries:
        queue.push(e)
    assert len(queue.runs) > 10 and [queue.pop() for _ in entries] == sorted(entries) and queue.least() is None


# ---- periodic runs


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = crc(doc_id) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def rows_of(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_runs_of_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(queries.op13_periodic_runs(spark, sf_dir))
    assert got == sorted((plain_row(*d) for d in docs), key=str) and sum(r[1] > 0 for r in got) > 5


def test_runs_of_odd_rows(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(600):
        w = [rng.choice("abc") if rng.random() < 0.7 else "ü" for _ in range(rng.randrange(0, 90))]
        a, p = rng.randrange(len(w) + 1), rng.randrange(1, 12)
        for j in range(a, min(len(w), a + rng.randrange(80))):
            w[j] = w[a + (j - a) % p] if a + (j - a) % p < len(w) else w[j]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t ", " ", "\x0b", "\x1c"]) for x in w)))
    rows += [(700, None), (701, ""), (702, " \n"), (None, "x " * 20), (None, None), (5, "y " * 30), (5, "other text"), (5, "other text"), (703, "k l m " * 9000), (704, "\x00 " * 8)]
    folder = written(spark, tmp_path, [(*r, "clash") for r in rows], "doc_id long, text string, key string", "documents")
    assert rows_of(queries.op13_periodic_runs(spark, folder)) == sorted((plain_row(*r) for r in rows), key=str)


@pytest.mark.parametrize("row", [4, 1 << 12])
def test_tiles_of_random_words(monkeypatch, row):
    rng = random.Random(9)
    monkeypatch.setattr(runs, "ROW", row)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(120))]
        a, p = rng.randrange(len(w) + 1), rng.randrange(1, 30)
        for i in range(a + p, len(w)):
            w[i] = w[i - p]
        ids, found = runs.numbered(w), defaultdict(list)
        for octave, boundaries, begin, end in runs.tile_rows(ids):
            for q, x, y in runs.solve_row(ids[begin:end].tolist(), begin, octave, boundaries):
                found[q].append((x, y))
        whole = {}
        for q in sorted(found):
            islands = []
            for x, y in sorted(found[q]):
                if islands and x <= islands[-1][1]:
                    islands[-1][1] = max(islands[-1][1], y)
                else:
                    islands.append([x, y])
            for x, y in islands:
                if y - x + q >= max(6, 4 * q):
                    whole.setdefault((x, y - x + q), q)
        assert sorted((s, n, q) for (s, n), q in whole.items()) == plain_runs(w)


def test_runs_of_nothing(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
