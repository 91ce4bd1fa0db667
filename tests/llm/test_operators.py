"""Each operator against brute force, exact round trips or held-out accuracy, with the edge cases of its docstring."""

import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tabularium.llm import decontam, langid, lines, media, minhash, mixing, queries, sharding, suffix, tokens, warc
from tabularium.llm.shared import new_folder
from tabularium.llm.textkit import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, keys string, id string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", "s", 0, "x", "y", "z") for d, t in rows], SCHEMA)


def ragged(seed, n, alphabet="ab \n", base=400):
    """Texts cut from one string, so that they share passages; with copies, nulls, empty and long ones."""
    r = random.Random(seed)
    whole = "".join(r.choice(alphabet) for _ in range(base))
    rows = [(i, "".join(whole[(k := r.randrange(base - 100)) : k + r.randrange(20, 120)] for _ in range(r.randrange(1, 6)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "x" * 5000), (n + 3, rows[5][1]), (n + 4, rows[5][1]), (n + 5, "é" * 80), (n + 6, "zé" + "é" * 60), (None, rows[6][1])]


# ---- 1


def word_sets(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    up = {d: d for d, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {d: word_sets(t or "") for d, t in rows}
    for (a, s), (b, t) in itertools.combinations([(d, t or "") for d, t in rows], 2):
        both = len(sets[a] & sets[b])
        if s == t or both and both >= 0.8 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {d: top(d) for d in up}


def test_near_duplicates_are_those_of_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(8):
        base = [r.choice(vocabulary) for _ in range(r.choice([30, 90, 200]))]
        for _ in range(7):
            own = base.copy()
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One, two!"), (n + 4, rows[0][1]), (n + 5, "...")]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(table(spark, [*rows, (None, "left out")])).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_weighted_similarity(weighted):
    e = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if weighted:
        w = np.concatenate([np.full(300, 3.5), np.where(np.arange(300) < 60, 1.0, 3.5)])
        s, want = minhash.signatures(np.concatenate([e, e]), np.array([0, 300, 600]), w, 1500), (60 + 240 * 3.5) / (300 * 3.5)
    else:
        s, want = minhash.signatures(np.concatenate([e[:240], e[60:]]), np.array([0, 240, 480]), None, 1500), 180 / 300
    assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_prefix_filter_loses_no_pair(spark):
    r = random.Random(4)
    sets = [sorted(r.sample(range(60), r.randrange(5, 40))) for _ in range(60)]
    sets += [sorted({*s[1:], 99}) for s in sets[:30]]
    df = spark.createDataFrame([(i, bytearray(np.array(s, np.int64).tobytes()), i) for i, s in enumerate(sets)], "id long, shingles binary, label long")
    got = {(x.a, x.b) for x in minhash.across(df, 0.8).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert want and want <= got


# ---- 2


def test_mixing_reaches_targets_and_keeps_clean_documents(spark):
    r = random.Random(2)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        kind = r.choice(["high", "high", "low", "toxic"])
        words = [r.choice(plain) for _ in range(r.randrange(20, 60))]
        if kind == "toxic":
            words[::7] = ["nasty"] * len(words[::7])
        text = " ### ".join(words) if kind == "low" else " ".join(words)
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    known = spark.createDataFrame([*labels, (10_000, 1, 1), (2, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, [*rows, (900, None), (901, ""), (900, None)])
    out = {x.doc_id: x for x in mixing.mix_rates(docs, known, {"high": 0.6, "low": 0.3, "toxic": 0.1}).collect()}
    total = sum(x.tokens for x in out.values())
    for d, share in (("high", 0.6), ("low", 0.3), ("toxic", 0.1)):
        assert abs(sum(x.rate * x.tokens * x[f"p_{d}"] for x in out.values()) / total - share) < 0.02
    assert all(x.rate >= 0 for x in out.values()) and out[900].tokens == 0
    kept = {x.doc_id for x in mixing.mix_rates(docs, known, None).collect() if x.rate >= 0.5}
    assert {i for i, t in rows if "nasty" not in t} <= kept and not {i for i, t in rows if "nasty" in t} & kept


def test_mixing_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix_rates(table(spark, [(1, "a b"), (2, None)]), none, None).count() == 2
    assert mixing.mix_rates(table(spark, []), none, None).count() == 0


def rare_rows(r, n, rare, first=0):
    """Texts of common words; toxic ones (odd ids) hold three of many rare words besides."""
    plain = [f"word{i}" for i in range(200)]
    return [(i, " ".join(r.sample([*(r.choice(plain) for _ in range(30)), *(r.sample(rare, 3) if i % 2 else [])], 33 if i % 2 else 30))) for i in range(first, first + n)]


@pytest.mark.parametrize("n, n_rare", [(600, 150), (6000, 600), (80, 16)])
def test_rare_words_of_toxic_documents_add_up(n, n_rare):
    """No word has four standard errors: each is in about 6, 15 and 8 toxic documents and in no clean one."""
    r = random.Random(8)
    rare = [f"slur{i}" for i in range(n_rare)]
    texts = [t for _, t in rare_rows(r, n, rare)]
    bucket, at, marks, _ = mixing.features(texts)
    made = mixing.train(bucket, at, marks, np.arange(n) % 2)
    new = [t for _, t in rare_rows(r, 400, rare)]
    p = made.probability(*mixing.features(new)[:3])
    assert p[1::2].mean() > 0.9 and p[::2].mean() < 0.1
    assert sum(made.ratio[mixing.features([w])[0][0]] > 0 for w in rare) > 0.98 * n_rare  # a few share a common word's bucket


def test_each_classifier_uses_rows_with_its_own_label(spark):
    r = random.Random(9)
    rows = rare_rows(r, 200, ["nasty", "awful", "vile", "gross"])
    known = spark.createDataFrame([(i, None, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in mixing.mix_rates(table(spark, rows), known, mixing.TARGETS).collect()}
    assert all((out[i].p_toxic > 0.5) == bool(i % 2) for i in range(200))
    assert all(out[i].p_low == 0 for i in range(200))


# ---- 3


def test_counts_follow_random_edits():
    counter, r = tokens.Counter.of(tokens.VOCABULARY), random.Random(5)
    parts = ["", "'", "r", "e", "s", " ", "  ", "\n", "foo", "1", " 9", "é", "'re", "!!", "\t", "llo w", "😀"]
    for text in ["", "a", "it's  'rX", "   ", "'r 're", "a\n\n\n b", "The quick 😀 brown fox. " * 30]:
        tree, now = tokens.TokenTree(*counter.pieces(text)), text
        for _ in range(40):
            a = r.randrange(len(now) + 1)
            b, new = min(len(now), a + r.choice([0, 0, 1, 2, 5, 60])), "".join(r.choice(parts) for _ in range(r.randrange(4)))
            want = now[:a] + new + now[b:]
            now, _ = tree.edit(now, a, b, new, counter)
            assert now == want and tree.total == len(counter.encoding.encode_ordinary(now)) and tree.chars[1] == len(now)


def test_recount_of_a_table(spark):
    rows = [(1, "The cat sat."), (2, None), (3, ""), (4, "abc " * 2000), (4, "abc " * 2000)]
    edits = spark.createDataFrame([(1, 4, 7, "dog"), (1, 5, 9, "lost"), (1, 90, 95, "!"), (4, 4000, 4004, "x"), (2, 0, 5, "new"), (1, None, 3, "")], "doc_id long, start int, end int, text string")
    docs = tokens.with_edits(table(spark, rows), edits)
    kept = tokens.recount(tokens.build(docs)).collect()
    got = {x.doc_id: x for x in kept}
    count = lambda t: len(tokens.Counter.of(tokens.VOCABULARY).encoding.encode_ordinary(t))
    assert (got[1].n_tokens, got[1].n_tokens_after, got[1].n_edits) == (count("The cat sat."), count("The dog sat.!"), 2)
    assert (got[2].n_tokens, got[2].n_tokens_after) == (0, count("new")) and got[3].n_tokens_after == 0
    long = "abc " * 2000
    assert got[4].n_tokens_after == count(long[:4000] + "x" + long[4004:]) and got[4].n_reencoded < 10


def test_query_counts_equal_a_full_encoding(spark, sf_dir):
    got = {x.doc_id: x for x in queries.op3_edit_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", tokens.redactions(F.col("text")).alias("e")).collect()
    encode, again = tokens.Counter.of(tokens.VOCABULARY).encoding.encode_ordinary, {}
    for d in docs:
        text = d.text or ""
        assert got[d.doc_id].n_tokens == len(encode(text))
        for a, b, new in reversed(tokens.settled(d.e, len(text))):
            text = text[:a] + new + text[b:]
        assert got[d.doc_id].n_tokens_after == len(encode(text))
        again[d.doc_id] = text
    texts = spark.createDataFrame(list(again.items()), "doc_id long, text string")
    for d in texts.select("doc_id", "text", tokens.redactions(F.col("text")).alias("e")).collect():
        text = d.text
        for a, b, new in reversed(tokens.settled(d.e, len(text))):
            text = text[:a] + new + text[b:]
        x = got[d.doc_id]
        assert x.n_tokens_2 == len(encode(text)) and x.n_edits_2 == len(tokens.settled(d.e, len(d.text)))
        assert x.n_blocks_read <= 4 * x.n_edits_2 and x.n_blocks_read <= x.n_blocks  # no edit opens more than the blocks around it


def test_edits_of_a_pass_are_found_in_linear_time(spark):
    def plain(text):
        out, text = [], text or ""
        for pattern, new in ((r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "<EMAIL>"), ("[0-9]+", "<NUM>"), ("\n", "\n\n")):
            if found := re.search(pattern, text):
                at = text.index(found[0])
                out.append((at, at + len(found[0]), new))
        return out + ([(len(text) - 40, len(text), "")] if len(text) > 80 else [])

    r = random.Random(23)
    texts = [None, "", "x a@b.c y 12\nz", "--.@a-.c..d 1", "é@b.c ée@b.c", "a@b.c" * 40, "日" * 81, "\n" * 80]
    texts += ["".join(r.choice("aZ9.-_@@é \n") for _ in range(r.randrange(120))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", tokens.redactions(F.col("text")).alias("e")).collect()
    assert {x.k: [tuple(e) for e in x.e] for x in rows} == {k: plain(t) for k, t in enumerate(texts)}
    long, began = "a" * 200_000 + " @", time.monotonic()
    [row] = spark.createDataFrame([(long,)], "text string").select(tokens.redactions(F.col("text")).alias("e")).collect()
    assert [tuple(e) for e in row.e] == [(len(long) - 40, len(long), "")] and time.monotonic() - began < 10


def test_trees_of_several_rounds(spark):
    """Trees that are packed and restored between edits keep the sums of a full encoding, and read only what edits touch."""
    counter, r = tokens.Counter.of(tokens.VOCABULARY), random.Random(15)
    text = "It's a 12 word é line.\n" * 400
    sums, blocks = tokens.TokenTree(*counter.pieces(text)).kept()
    for _ in range(60):
        tree = tokens.TokenTree.restored(sums, blocks)
        a = r.randrange(len(text) + 1)
        b = min(len(text), a + r.choice([0, 1, 3, 40]))
        text, _ = tree.edit(text, a, b, r.choice(["", "x", " new words", "\n\n", "long " * 300]), counter)
        assert tree.total == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text) and tree.opened <= 4
        sums, blocks = tree.kept()
        again = tokens.TokenTree.restored(sums, blocks)
        assert [x for b in range(len(again.ends)) for x in again.block(b)[0]] == counter.pieces(text)[0] and again.pieces == len(counter.pieces(text)[0])


# ---- 4


def test_edit_distance_by_hand():
    def one(item, around):
        a = np.array([item], np.uint64)
        return int(decontam.edits(a, np.array([len(item)]), np.array([around], np.uint64))[0])

    assert one([2, 3, 4, 5], [9, 2, 3, 4, 5, 9]) == 0 and one([2, 3, 4, 5], [9, 2, 4, 5, 9]) == 1 and one([2, 3, 4], [9, 8, 7]) == 3


def test_passages_with_edits_are_found_and_clean_texts_are_not(spark, sf_dir):
    r = random.Random(3)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    filler = [f"other{i}" for i in range(300)]
    rows, want = [], set()
    for n, (item, text) in enumerate(items * 4):
        w = text.split()
        for _ in range(r.randrange(0, decontam.limit(len(w)) + 1)):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at : at + (kind != 2)] = [f"new{r.randrange(99)}"] if kind != 1 else []
        rows.append((n, " ".join([*r.sample(filler, 30), *w, *r.sample(filler, 30)])))
        want.add((n, item))
    rows += [(5000 + i, " ".join(r.choice(filler) for _ in range(80))) for i in range(50)] + [(6000, None), (6001, ""), (6002, "a " * 5000), (0, rows[0][1])]
    bench = spark.createDataFrame([*items, (900, None), (901, "..."), (902, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.matches(table(spark, rows), bench).collect()}
    assert len(want & got) >= 0.98 * len(want) and not {d for d, _ in got if d >= 5000}
    left = decontam.clean(table(spark, rows), bench)
    assert left.columns == SCHEMA.replace(",", "").split()[::2] and {x.doc_id for x in left.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontam.matches(table(spark, rows), bench.where("false")).count() == 0


# ---- 5


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries.op5_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([x.lang == x.lang_pred for x in found]) > 0.97 and all(0 <= x.score <= 1 for x in found)


def test_spans_scripts_and_texts_without_language(spark):
    r = random.Random(6)
    english, russian, greek = ([a + b for a in x for b in x] for x in (["the", "and", "ing", "ion"], ["про", "ста", "ние", "ого"], ["και", "του", "ους", "στη"]))
    rows = [(i, " ".join(r.choice(w) for _ in range(40)), lang) for i, (w, lang) in enumerate([(english, "en"), (russian, "ru"), (greek, "el")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    mixed = " ".join(english[:12]) + "; " + " ".join(russian[:12])
    probe = table(spark, [(1, mixed), (2, None), (3, ""), (4, "123 !?"), (5, "ингпро"), (None, english[0]), (6, "α" * 3)])
    got = {x.doc_id: x for x in langid.predict(probe, model).collect()}
    assert got[1].n_spans == 2 and [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[5].lang_pred == "ru" and got[6].lang_pred == "el"
    parts = [(x.lang, mixed[x.start : x.end]) for x in langid.spans(probe, model).where("doc_id = 1").orderBy("span_no").collect()]
    assert parts == [("en", " ".join(english[:12])), ("ru", " ".join(russian[:12]))]
    assert sorted(x.doc_id or 0 for x in langid.keep_known(probe, model).collect()) == [0, 1, 5, 6]
    none = langid.fit(docs.where("false"))
    assert {x.lang_pred for x in langid.predict(probe, none).collect()} == {"und"}


def test_no_detour_beats_the_labels():
    r = np.random.default_rng(0)
    model = langid.Model(("a", "b", "c"), np.log(r.dirichlet(np.ones(langid.BUCKETS), 3).T + 1e-9).astype(np.float32), np.ones((len(langid.SCRIPT_NAMES), 3), bool))
    texts = [" ".join("".join(chr(97 + c) for c in r.integers(0, 26, 4)) for _ in range(n)) for n in (1, 2, 5, 30, 200)]
    got, path, _ = langid.label(texts, model)
    score = np.stack([np.add.reduceat(model.columns[j][got["gram"]], got["first"]) for j in range(3)], 1).astype(float)
    for a, b in zip(got["text"], got["text"][1:]):
        value = lambda p: score[np.arange(a, b), p].sum() - langid.PENALTY * (p[1:] != p[:-1]).sum()  # noqa: E731, B023
        assert abs(value(langid._viterbi(score[a:b], langid.PENALTY)) - value(path[a:b])) < 1e-6


# ---- 6


def test_archives_come_back(spark):
    rows = [(i, f"http://x/{i}\r\nbad é", f"<p>page {i % 40} é</p>" * 20) for i in range(200)] + [(500, None, None), (501, "u", ""), (502, "u", "z" * 300000), (None, "u", "<p>page 3 é</p>" * 20), (7, "again", "<p>page 7 é</p>" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_folder(spark, "warc")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    by_payload = {}
    for p, _, h in rows:
        if p is not None:
            by_payload[h or ""] = max(p, by_payload.get(h or "", -1))
    for x in got:
        html = next(h for p, _, h in rows if p == x.page_id) or ""
        raw = html.encode()
        assert x.payload_bytes == len(raw) and (x.record_type == "response") == (x.page_id == by_payload[html]) and x.refers_to == (None if x.page_id == by_payload[html] else by_payload[html])
        assert x.payload is None if x.record_type == "revisit" else bytes(x.payload) == raw
    one = next(spark.read.format("binaryFile").load(path).toLocalIterator())
    data = bytes(one.content)
    plain = b"".join(r for _, _, r in warc.read_archive(data))
    if struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        assert tool.stream_reader(data, read_across_frames=True).read() == plain
    assert plain.startswith(b"WARC/1.1\r\n")


def test_no_pages(spark):
    path = new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


# ---- 7


def brute_lines(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10 and d is not None:
                held.setdefault(key(s), set()).add(d)
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [s for s in all_ if d is None or len(held.get(key(s), ())) < 2 or min(held[key(s)]) == d]
        out.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_are_those_of_brute_force(spark):
    r = random.Random(7)
    pool = ["short", "A Line That Repeats", "a line that repeats \t", "\x0bÉtat de la ligne", "état de la ligne", "exactly 10", "nine char", "", " "] + [f"only once {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 9)))) for i in range(60)] + [(70, None), (71, ""), (72, "x" * 9000 + "\na line that repeats"), (None, "a line that repeats"), (3, "a line that repeats")]
    rows.append(rows[4])
    got = lines.dedup_lines(table(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("s")).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert lines.dedup_lines(table(spark, [])).count() == 0


# ---- 8


def test_shards(spark):
    rows = [(i, f"text {i}" * (i % 7)) for i in range(3000)] + [(5000, None), (None, "no id"), (None, None), (7, "again")]
    got = sharding.shard(table(spark, rows), new_folder(spark, "map")).collect()
    by_id = {}
    for x in got:
        text = x.size - 1
        assert x.grown_shard in (x.shard, 8) and text >= 0 and by_id.setdefault(x.doc_id, x.shard) == x.shard or x.doc_id is None
    assert sorted((x.size, x.text_crc32) for x in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    counts = [sorted(x.slot for x in got if x.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) < 1.35 * min(map(len, counts))
    assert 0.07 < np.mean([x.grown_shard == 8 for x in got]) < 0.16
    assert sharding.shard(table(spark, []), new_folder(spark, "map")).count() == 0


def test_map_versions_and_rebalancing(spark):
    path = new_folder(spark, "map")
    one = sharding.first_map(spark, 4, 64)
    sharding.store_map(one, path)
    sizes = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), F.when(F.col("id") % 4 == 0, 100).otherwise(10).alias("slot_bytes"))
    sharding.store_map(sharding.rebalance_map(sharding.load_map(spark, path), sizes, 4), path)
    new = sharding.load_map(spark, path)
    assert {x.version for x in new.collect()} == {2} and new.count() == 64
    loads = [x.b for x in new.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("slot_bytes").alias("b")).collect()]
    assert len(loads) == 4 and max(loads) < 2 * sum(loads) / 4


# ---- 9


def brute_passages(rows, span=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - span + 1 if d is not None else 0):
            first[b[s : s + span]] = min(d, first.get(b[s : s + span], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1 if d is not None else 0):
            if first[b[s : s + span]] < d:
                gone[s : s + span] = b"\1" * span
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", ["ab ", "abcdefgh \n"])
def test_passages_are_those_of_brute_force(spark, alphabet):
    rows = ragged(3, 70, alphabet)
    rows.append(rows[8])
    got = suffix.remove_repeats(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_passages(rows)


def test_no_passages(spark):
    assert suffix.remove_repeats(table(spark, [])).count() == 0


def test_suffix_order_is_byte_order():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 400).astype(np.uint8)
    start = r.integers(0, 390, 200)
    length, group = np.minimum(r.integers(0, 40, 200), 400 - start), r.integers(0, 5, 200)
    from tabularium.llm.textkit import prefix_hash

    order = suffix.suffix_order(data, prefix_hash(data), start, length, group)
    held = [(int(group[i]), data[start[i] : start[i] + length[i]].tobytes()) for i in order]
    assert held == sorted(held)


# ---- 10


def simple_lzw(stream, bits):
    clear, out, at = 1 << bits, [], 0
    table, width, prev = {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}, bits + 1, None
    value = int.from_bytes(stream, "little")
    while at + width <= 8 * len(stream):
        code, at = value >> at & (1 << width) - 1, at + width
        if code == clear:
            table, width, prev = {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}, bits + 1, None
            continue
        if code == clear + 1:
            break
        entry = table[code] if code in table else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table[len(table)] = prev + entry[:1]
        width = min(12, max(width, len(table).bit_length() if len(table) < 4096 else 12))
        out.append(entry)
        prev = entry
    return b"".join(out)


@pytest.mark.parametrize("bits, n", [(8, 0), (8, 1), (8, 9000), (4, 30000), (2, 9000)])
def test_code_streams_round_trip(bits, n):
    r = random.Random(bits + n)
    data = bytes(r.randrange(1 << bits) if r.random() < 0.4 else 1 for _ in range(n))
    stream = media.lzw_encode(data, bits)
    assert media.lzw_decode(stream, bits) == data == simple_lzw(stream, bits)


def tiny(frames, palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff", size=(2, 2)):
    """frames: (disposal, transparent or -1, left, top, width, height, samples, flags)."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), palette]
    for disposal, clear, left, top, w, h, samples, flags in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear >= 0), 5, max(clear, 0), 0))
        codes = media.lzw_encode(bytes(samples), 2)
        out.append(struct.pack("<BHHHHBB", 0x2C, left, top, w, h, flags, 2) + bytes([len(codes)]) + codes + b"\0")
    return b"".join([*out, b"\x3b"])


def colours(canvas):
    return ["-" if not p[3] else "krgb"[[(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)].index(tuple(p[:3]))] for p in canvas.reshape(-1, 4).tolist()]


@pytest.mark.parametrize("disposal, want", [(1, "rbrr"), (2, "-b--"), (3, "-b--")])
def test_disposal_and_transparency(disposal, want):
    data = tiny([(disposal, -1, 0, 0, 2, 2, [1, 1, 1, 1], 0), (0, 0, 0, 0, 2, 1, [0, 3], 0)])
    frames = [(f["start_ms"], "".join(colours(f["canvas"].copy()))) for f in media.decode_gif(data)]
    assert frames == [(0, "rrrr"), (50, want)]


def test_interlaced_rows():
    f = next(media.decode_gif(tiny([(0, -1, 0, 0, 1, 4, [0, 2, 1, 3], 0x40)], size=(1, 4))))
    assert "".join(colours(f["canvas"])) == "krgb"


def test_texts_come_back_from_gifs(spark):
    rows = ragged(9, 20, "abc é\n")
    got = sorted(map(tuple, media.read_texts(media.store_texts(table(spark, rows))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()), key=str)
    want = []
    for d, t in rows:
        n, p = media.pad(t)
        assert len(p) % 576 == 0 and p
        want.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want, key=str)


def test_frames_table_and_broken_media(spark):
    good = tiny([(1, -1, 0, 0, 2, 2, [1, 1, 2, 3], 0), (1, -1, 0, 0, 1, 1, [2], 0)])
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None), (4, bytearray(good[:-30]))], "k long, media binary")
    rows = {(x.k, x.frame_no): x for x in media.gif_frames(df, "k", "media").collect()}
    assert rows[1, 0].red[15] == 1 + 1 and rows[1, 1].start_ms == 50 and rows[2, None].error and rows[3, None].error and any(x.error for (k, _), x in rows.items() if k == 4)


def test_streams_of_one_batch_do_not_mix():
    r = random.Random(4)
    held = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 1, 30_000, 5, 700)] + [b"\xff" * 18_432]
    streams = media.lzw_encode_all(held)
    broken = media.lzw_encode_all([b"ab" * 40])[0][:2] + b"\xff\xff\xff"
    assert media.lzw_decode_all([*streams[:3], broken, *streams[3:]], 8) == [*held[:3], None, *held[3:]]
    assert [simple_lzw(s, 8) for s in streams] == held


def test_a_deferred_clear():
    codes, width = [256, *(v for _ in range(3000) for v in (97, 98))], []
    for j in range(-1, len(codes) - 1):
        width.append(9 if j < 0 else min(12, (258 + max(0, j - 1)).bit_length()))
    value, at = 0, 0
    for c, w in zip([*codes, 257], [*width, 12]):
        value, at = value | c << at, at + w
    assert media.lzw_decode(value.to_bytes(at // 8 + 1, "little"), 8) == b"ab" * 3000


def test_every_column_of_stored_texts(spark):
    rows = ragged(10, 12, "abc é\n") + [(90, "long and dull " * 9000), (91, "long and dull " * 9000)]
    stored = {x.doc_id: bytes(x.media) for x in media.store_texts(table(spark, rows)).collect()}
    for x in media.read_texts(media.store_texts(table(spark, rows))).collect():
        gif, payload = stored[x.doc_id], media.pad(dict(rows)[x.doc_id])[1]
        assert (x.media_bytes, x.media_sha256) == (len(gif), hashlib.sha256(gif).hexdigest())
        assert x.feature == ",".join(str(sum(payload.count(b) for b in range(16 * k, 16 * k + 16))) for k in range(16))
        assert x.n_frames == -(-len(payload) // 18_432) and x.duration_ms == 40 * x.n_frames
        at, parts = 13 + 768, []
        while gif[at] == 0x21:
            at, codes = at + 8 + 11, b""
            while gif[at]:
                codes, at = codes + gif[at + 1 : at + 1 + gif[at]], at + 1 + gif[at]
            parts.append(simple_lzw(codes, 8))
            at += 1
        assert b"".join(parts) == payload and gif[at:] == b"\x3b"
    assert stored[90] == stored[91]


def test_no_texts_to_store(spark):
    assert media.read_texts(media.store_texts(table(spark, []))).count() == 0


# ---- more of 8


def test_the_law_of_the_key(spark):
    """shard(n + 1) is shard(n) but for what goes into the new shard, and nothing but id and shard count decides."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(3000, None), (7, "again")]
    by = {}
    for n in (1, 8, 9, 10):
        got = sharding.shard(table(spark, rows if n != 9 else [(d, "other") for d, _ in rows[::-1]]), new_folder(spark, "map"), n_shards=n).collect()
        by[n] = {x.doc_id: (x.shard, x.grown_shard) for x in got}
    assert {s for s, _ in by[1].values()} == {0}
    for n in (8, 9):
        assert all(by[n + 1][d][0] == grown and grown in (old, n) for d, (old, grown) in by[n].items())
    assert 8 < sum(1 for d, (s, _) in by[9].items() if s == 8) < 2000 / 9 * 1.4


def test_every_place_by_brute_force(spark):
    rows = [(i % 900, f"text {i % 700}") for i in range(1200)] + [(5000, None), (None, "no id"), (None, None), (None, None), (-3, "x" * 300_000)]
    path = new_folder(spark, "map")
    slots = {x.doc_id: x.v for x in table(spark, rows).select("doc_id", sharding.virtual_slot(F.col("doc_id"), F.col("text")).alias("v")).collect()}
    got = sharding.shard(table(spark, rows), path).collect()
    placed = {x.virtual_slot: x.shard for x in sharding.load_map(spark, path, 1).collect()}
    sizes = {}
    for x in got:
        sizes[x.virtual_slot] = sizes.get(x.virtual_slot, 0) + x.size
    assert all(x.virtual_slot == slots[x.doc_id] for x in got if x.doc_id is not None)
    assert all((x.law, x.shard, x.slot_bytes, x.map_version) == ("key", placed[x.virtual_slot], sizes[x.virtual_slot], 1) for x in got)
    for s in range(8):
        mine = sorted((x for x in got if x.shard == s), key=lambda x: x.slot)
        assert [x.slot for x in mine] == list(range(len(mine)))
        assert [x.virtual_slot for x in mine] == sorted(x.virtual_slot for x in mine)
    again = sharding.shard(table(spark, rows), path).collect()  # a later run finds the map
    assert sorted(map(str, again)) == sorted(map(str, got)) and sharding.versions(spark, path) == [1, 2]


def test_bytes_are_evened_by_editing_the_map(spark):
    r = random.Random(5)
    rows = [(i, "x" * int(r.paretovariate(1.5) * 40)) for i in range(6000)]
    path = new_folder(spark, "map")
    got = sharding.shard(table(spark, rows), path, law="bytes").collect()
    loads = [sum(x.size for x in got if x.shard == s) for s in range(8)]
    largest = max(x.slot_bytes for x in got)
    assert max(loads) - min(loads) <= 2 * largest and {x.map_version for x in got} == {2} and {x.grown_shard for x in got} == {None}
    assert len(got) == 6000 and all(sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got))) for s in range(8))
    with pytest.raises(ValueError):
        sharding.shard(table(spark, rows), path, law="rows")


# ---- more of 1 and 2


def test_unlike_texts_of_one_id_are_classed_apart(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, b + " more"), (0, a + " first"), (None, a)]
    got = sorted((x.doc_id, x.class_id, x.leads, x.copy_of) for x in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == [(0, 0, True, 0), (1, 0, False, 1), (1, 1, True, 1), (1, 1, True, 1), (2, 0, False, 2), (3, 1, False, 3)]
    kept = minhash.keep_leads(table(spark, rows).withColumn("_row", F.lit(1)).withColumn("_id", F.lit("x")).withColumn("a.b", F.lit(2)))
    assert kept.columns == [*table(spark, []).columns, "_row", "_id", "a.b"]
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(0, rows[5][1]), (1, b), (None, a)], key=str)


def test_recall_of_near_duplicates_on_a_table(spark):
    """All pairs of similarity 0.8 of the small documents table meet in one class (against inverted lists of all shingles)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()}
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert got == brute_classes(rows)


def test_long_texts_are_whole_in_near_duplicates(spark):
    r = random.Random(12)
    base = [f"w{r.randrange(5000)}" for _ in range(120_000)]
    tail = base[:100_000] + [f"v{r.randrange(5000)}" for _ in range(20_000)]
    other = base[:60_000] + [f"u{r.randrange(5000)}" for _ in range(60_000)]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(table(spark, [(1, " ".join(base)), (2, " ".join(base[:110_000])), (3, " ".join(other)), (4, " ".join(tail))])).collect()}
    assert got == brute_classes([(1, " ".join(base)), (2, " ".join(base[:110_000])), (3, " ".join(other)), (4, " ".join(tail))])


def nearest_totals(a, want, back):
    """The point nearest to ``want`` (in the metric ``back``) among a @ r for r >= 0: active sets by Lawson and Hanson."""
    root = np.linalg.cholesky(back).T
    m, b = root @ a, root @ want
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(500):
        pull = m.T @ (b - m @ x)
        if free.all() or pull[~free].max() <= 1e-9 * np.abs(m).max() * max(1.0, np.abs(b).max()):
            break
        free[np.flatnonzero(~free)[pull[~free].argmax()]] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(m[:, free], b, rcond=None)[0]
            if (z[free] > 1e-12).all():
                x = z
                break
            low = free & (z <= 1e-12)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            free &= x > 1e-12
    return a @ x


@pytest.mark.parametrize("targets, near", [({"high": 0.3, "low": 0.3, "toxic": 0.4}, 1e-4), ({"high": 0.75, "low": 0.2, "toxic": 0.05}, 1e-3), ({"high": 0.0, "low": 0.0, "toxic": 1.0}, 0.05)])
def test_rates_reach_what_an_independent_least_squares_reaches(spark, targets, near):
    r = np.random.default_rng(3)
    p = r.dirichlet([2.0, 1.0, 0.5], 60) * 0.8 + np.array([0.1, 0.06, 0.04])  # no pure domain: some targets are out of reach
    tokens = r.integers(5, 500, 60)
    soft = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p_high double, p_low double, p_toxic double")
    out, how = mixing.rates(soft, targets)
    a = (p * tokens[:, None]).T
    want = np.array([targets[d] for d in mixing.DOMAINS]) * a.sum()
    best = nearest_totals(a, want, np.linalg.inv((p * tokens[:, None]).T @ p))
    assert np.abs(how.reached - best).max() < near * a.sum() and np.allclose(how.wanted, want)
    rate = np.array([x.rate for x in out.orderBy("doc_id").collect()])
    assert np.allclose(a @ rate, how.reached) and np.allclose(how.rate(p), rate) and rate.min() >= 0


def test_the_mix_itself_has_the_wanted_tokens(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        kind = ["high", "high", "low", "toxic"][i % 4]
        w = [f"word{r.randrange(200)}" for _ in range(r.randrange(20, 60))]
        rows.append((i, (" ### " if kind == "low" else " ").join([*w, *(["nasty"] * 6 if kind == "toxic" else [])])))
        labels += [(i, int(kind != "low"), int(kind == "toxic"))] if i % 3 else []
    known, docs = spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), table(spark, [*rows, (5000, None), (None, "word1 word2")])
    targets = {"high": 0.5, "low": 0.45, "toxic": 0.05}
    out = mixing.realise(docs, known, targets)
    assert out.columns == docs.columns
    held = {d: 0 for d in targets}
    for x in out.where("doc_id < 5000").collect():
        held[["high", "high", "low", "toxic"][x.doc_id % 4]] += len(mixing.words([x.text])[0])
    whole = sum(len(mixing.words([t])[0]) for _, t in rows)
    assert all(abs(held[d] / whole - share) < 0.02 for d, share in targets.items())
    clean = [x.doc_id for x in mixing.realise(docs, known, None, nearest=True).collect()]
    assert sorted(clean, key=str) == sorted([*(i for i in range(900) if i % 4 != 3), 5000, None], key=str)
    assert mixing.realise(docs.where("false"), known, targets).count() == 0
    assert {x.target_miss < 0.01 for x in mixing.mix_rates(docs, known, targets).collect()} == {True}


# ---- more of 4


def least_edits(item, text):
    """Edit distance of a word list to the best of all stretches of another, and whether the whole table says so."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_matches_are_those_of_every_stretch(spark):
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [r.choice(vocabulary) for _ in range(r.randrange(3, 40))]) for i in range(24)]
    items += [(30, items[0][1]), (31, ["na"] * 12), (32, ["la", "lo"] * 10)]
    rows = []
    for n in range(60):
        w = items[n % 27][1].copy()
        for _ in range(r.randrange(0, 2 + len(w) // 3)):
            at, kind = r.randrange(len(w) + 1), r.randrange(3)
            w[at : at + (kind != 2)] = [r.choice(vocabulary)] if kind != 1 else []
        rows.append((n, [r.choice(vocabulary) for _ in range(r.randrange(0, 50))] + w + [r.choice(vocabulary) for _ in range(r.randrange(0, 50))]))
    rows += [(70, ["na"] * 300), (71, ["la"] * 200), (72, ["lo", "la"] * 150), (73, []), (74, rows[0][1] + rows[0][1])]
    want = {(d, i): e for d, t in rows for i, w in items if (e := least_edits(w, t)) <= decontam.limit(len(w))}
    docs = table(spark, [(d, " ".join(t)) for d, t in rows] + [(80, None)])
    bench = spark.createDataFrame([*((i, " ".join(w).upper()) for i, w in items), (40, None), (41, "?")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.matches(docs, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) > 50
    texts = dict(rows)
    for (d, i), x in got.items():
        assert want[d, i] <= x.edits <= decontam.limit(x.item_words) and 0 <= x.start_word <= len(texts[d])
        if x.edits == 0:
            assert texts[d][x.start_word : x.start_word + x.item_words] == dict(items)[i]
    assert sum(x.edits == want[k] for k, x in got.items()) >= 0.98 * len(got)
    assert decontam.matches(docs.where("false"), bench).count() == 0 and decontam.clean(docs.where("false"), bench).count() == 0


def test_words_that_repeat_on_and_on(spark):
    bench = spark.createDataFrame([(1, "a " * 500), (2, "a b " * 250)], "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.edits) for x in decontam.matches(table(spark, [(1, "a " * 20_000), (2, "b a " * 9000), (3, "a " * 300)]), bench).collect())
    assert got == [(1, 1, 0), (2, 2, 0)]


def test_lengths_that_miss_the_recall_go_on_unsampled(monkeypatch):
    r = np.random.default_rng(5)
    item = [f"w{i}" for i in range(40)]
    monkeypatch.setattr(decontam, "MOST", 1)
    monkeypatch.setattr(decontam.repetitions, "__defaults__", (decontam.RECALL, 1))
    made = decontam.Matcher([1], [" ".join(item)])
    assert made.repeat.tolist() == [0]
    for _ in range(40):
        w = item.copy()
        for at in r.choice(40, 9, replace=False):
            w[at] = "new"
        assert least_edits(item, w) == 9 and (not made._ranges(*decontam_words(w))[0].size or made.find([" ".join(w)])[0][:3] == (0, 0, 9))


def decontam_words(w):
    hashed, at = decontam.words([" ".join(w)])
    return hashed, np.zeros(len(hashed), np.int64)


@pytest.mark.parametrize("n", [8, 20, 45, 120])
def test_measured_recall_of_the_sampling(n):
    """Copies under as many edits as the limit allows, drawn anew, collide in the repetitions that the class got."""
    r = np.random.default_rng(n)
    items = [r.integers(2, 1 << 60, n).astype(np.uint64) for _ in range(30)]
    count, measured = decontam.repetitions(items)[decontam.length_class(n)]
    hit = []
    for w in items * 10:
        e = w.tolist()
        for _ in range(decontam.limit(n)):
            at, kind = int(r.integers(0, len(e))), int(r.integers(0, 3))
            e[at : at + (kind != 2)] = [int(r.integers(2, 1 << 60))] if kind != 1 else []
        a, b = np.array([w]), np.zeros((1, n), np.uint64)
        b[0, : min(n, len(e))] = e[:n]
        size = np.array([n])
        hit.append(count == 0 or any((decontam.sampled(a, size, k) == decontam.sampled(b, size, k))[0] for k in range(count)))
    assert measured >= 0.9 and np.mean(hit) >= 0.95


# ---- more of 6 and 7


def test_archives_end_by_size_and_all_have_a_dictionary(monkeypatch):
    r = random.Random(13)
    monkeypatch.setattr(warc, "PIECE_BYTES", 2000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 9000)
    monkeypatch.setattr(warc, "DICT_BYTES", 1024)
    held = [warc.make_record(i, f"http://x/{i}", bytes(r.randrange(256) for _ in range(r.choice([10, 700, 200_000 if i == 3 else 900]))), None, False) for i in range(120)]
    pieces = list(warc.archive_pieces(held, pieces=5, most=1 << 20))
    archives = [b"\n".join([*pieces[i : i + 5], b""]) for i in range(0, len(pieces), 5)]
    assert len(archives) > 3 and all(struct.unpack_from("<I", a)[0] == warc.DICT_MAGIC for a in archives)
    assert [raw for a in archives for _, _, raw in warc.read_archive(a)] == held
    small = list(warc.archive_pieces(held, pieces=50, most=6000))
    assert [raw for i in range(0, len(small), 50) for _, _, raw in warc.read_archive(b"\n".join([*small[i : i + 50], b""]))] == held and len(small) > 100
    one = b"\n".join([*warc.archive_pieces(held[:1]), b""])
    assert struct.unpack_from("<I", one)[0] == warc.DICT_MAGIC and [x for _, _, x in warc.read_archive(one)] == held[:1]
    assert list(warc.archive_pieces([])) == []


def test_long_first_pages_do_not_keep_an_archive_from_its_dictionary():
    held = [warc.make_record(i, "u", b"<p>%d</p>" % i * (300_000 if i < 3 else 30), None, False) for i in range(40)]
    data = b"\n".join([*warc.archive_pieces(held), b""])
    size = struct.unpack_from("<I", data, 4)[0]
    assert zstandard.ZstdCompressionDict(data[8 : 8 + size]).dict_id() != 0  # trained
    assert [x for _, _, x in warc.read_archive(data)] == held


def test_pages_with_clashing_columns(spark):
    rows = [(1, "u", "<p>a</p>", "x", "y", "z"), (2, "v", "<p>a</p>", "x", "y", "z"), (2, "v", "<p>a</p>", "x", "y", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, name string, refers_to string")
    path = new_folder(spark, "warc")
    warc.write_archives(pages, path)
    assert sorted((x.page_id, x.record_type, x.refers_to) for x in warc.read_archives(spark, path).collect()) == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]


def test_texts_of_very_many_lines(spark):
    import time

    long = "\n".join(f"line number {i}" for i in range(100_000))
    rows = [(1, long), (2, long), (3, "\n".join([*long.split("\n")[::2], "of its own here"]))]
    lines.dedup_lines(table(spark, rows[:1])).collect()
    began = time.time()
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in lines.dedup_lines(table(spark, rows)).collect()}
    assert time.time() - began < 60
    assert got == {1: (100_000, 0, long), 2: (100_000, 100_000, ""), 3: (50_001, 50_000, "of its own here")}
    three = {x.doc_id: x.n_dropped for x in lines.dedup_lines(table(spark, rows), min_docs=3).collect()}
    assert three == {1: 0, 2: 50_000, 3: 50_000}


# ---- more of 9


def test_a_passage_that_most_documents_share(spark, monkeypatch):
    """Equal surroundings in one task, remembered ones of earlier blocks, and ids in falling order."""
    r = random.Random(17)
    passage = "".join(r.choice("abcdefgh ") for _ in range(180))
    rows = [(400 - i, "".join(r.choice("ijkl ") for _ in range(r.randrange(0, 60))) + passage[r.choice([0, 0, 0, 7]) :] + "".join(r.choice("mnop ") for _ in range(r.randrange(0, 60)))) for i in range(300)]
    rows += [(500 + i, (passage[20:90] + "|") * 4) for i in range(40)]
    got = suffix.remove_repeats(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_passages(rows)


def test_settled_surroundings_of_small_blocks(spark):
    """Blocks of a few documents, so that what is remembered decides; all documents in one task."""
    import tabularium.llm.textkit as kit

    r = random.Random(18)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    rows = [(r.randrange(10**6) * 100 + i, "".join(r.choice("ijkl ") for _ in range(40)) + passage) for i in range(60)]
    df = spark.createDataFrame([(d, t, [0]) for d, t in rows], "doc_id long, text string, keys array<long>").coalesce(1)
    anchors_, hashed = suffix.anchors(np.frombuffer(passage.encode(), np.uint8), np.array([120]))
    key = (((hashed >> np.uint64(32)) % np.uint64(16)) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))
    df = df.withColumn("keys", F.array(*[F.lit(int(k)) for k in key.view(np.int64)])).withColumn("node", F.col("doc_id"))
    out = suffix._surroundings(df, 16, 50, 24).collect()
    inner = [x for x in out if x.left == 26]
    assert {x.doc_id for x in inner if x.right < 0} and all(len(x.around) == 0 for x in out if x.right < 0)
    full = [x for x in inner if x.right >= 0 and bytes(x.around) in passage.encode()]
    assert len(full) <= 2 * len({bytes(x.around) for x in full}) and min(d for d, _ in rows) in {x.doc_id for x in full}


def test_unlike_texts_of_one_id(spark):
    """Each is a document of its own; neither comes before the other, but a smaller id comes before both."""
    r = random.Random(19)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    x, y, z = word(80), word(90), word(70)
    rows = [(1, x), (1, x + "tail"), (2, word(30) + x[:60]), (2, y), (2, y + z), (2, z), (3, z + y), (3, x), (3, x), (None, x), (1, None), (2, "")]
    rows += [(r.randrange(4, 9), word(r.randrange(40)) + r.choice([x, y, z])[r.randrange(20) :] + word(r.randrange(40))) for _ in range(60)]
    got = suffix.remove_repeats(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_passages(rows)
    assert all(x.n_removed <= x.n_bytes for x in got)


# ---- more of 1


def check_links(rows, got):
    """Rows of unique ids: links are true pairs of unlike texts, and every text of a class of several has some."""
    text = dict(rows)
    elements, at = shingles(list(text.values()))
    sets = {d: set(elements[a:b].tolist()) for d, a, b in zip(text, at, at[1:])}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and bool(sets[a])
    reps = {x.copy_of for x in got}
    for x in got:
        true = [d for d in reps if d != x.copy_of and alike(d, x.copy_of)]
        assert x.n_links <= len(true) and (x.n_links > 0) == bool(true) == (x.linked_to is not None)
        assert x.linked_to is None or x.linked_to in true
    return sum(x.n_links for x in got if x.doc_id == x.copy_of) // 2


def test_links_of_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = queries.op1_dartminhash(spark, sf_dir).collect()
    texts = len({x.copy_of for x in got})
    n = check_links([tuple(d) for d in docs.collect()], got)
    assert n >= texts - len({x.class_id for x in got})  # links enough to join each class


def test_the_same_row_stays_whatever_the_order(spark):
    rows = [(1, "one two three four five six", i) for i in range(30)] + [(2, "other words than those of the first", 1)]
    kept = {tuple(minhash.keep_leads(spark.createDataFrame(rows[::step], "doc_id long, text string, n int").repartition(3)).orderBy("doc_id").collect()) for step in (1, -1)}
    assert len(kept) == 1 and len(next(iter(kept))) == 2


# ---- more of 3 and 5


def test_no_documents_to_count_or_label(spark):
    none = table(spark, []).withColumn("edits", F.lit(None))
    assert tokens.recount(tokens.build(none)).count() == 0
    model = langid.fit(table(spark, []))
    assert langid.predict(table(spark, []), model).count() == 0 and langid.spans(table(spark, []), model).count() == 0 and langid.keep_known(table(spark, []), model).count() == 0


def test_trees_of_long_pieces_and_of_a_clashing_column(spark):
    rows = [(1, "a" * 3000 + " b"), (2, " " * 5000), (3, None), (4, "one two")]
    edits = spark.createDataFrame([(1, 10, 20, "x y"), (2, 0, 4999, ""), (4, 0, 3, "three")], "doc_id long, start int, end int, text string")
    docs = tokens.with_edits(table(spark, rows).withColumn("edits", F.lit("mine")), edits)
    assert "edits_" in docs.columns
    kept = {x.doc_id: tuple(x) for x in tokens.recount(tokens.build(docs)).collect()}
    counter = tokens.Counter.of(tokens.VOCABULARY)
    for d, t in ((1, "a" * 10 + "x y" + "a" * 2980 + " b"), (2, " "), (3, ""), (4, "three two")):
        assert kept[d][4] == len(counter.encoding.encode_ordinary(t))


def test_labels_against_every_path():
    r = np.random.default_rng(2)
    model = langid.Model(("a", "b", "c"), np.log(r.dirichlet(np.ones(langid.BUCKETS) * 0.05, 3).T + 1e-9).astype(np.float32), np.ones((len(langid.SCRIPT_NAMES), 3), bool))
    texts = [" ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(1, 4))) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6) for _ in range(6)]
    got, path, _ = langid.label(texts, model)
    score = np.stack([np.add.reduceat(model.columns[j][got["gram"]], got["first"]) for j in range(3)], 1).astype(float)
    changed = 0
    for a, b in zip(got["text"], got["text"][1:]):
        def value(p):
            return sum(score[a + i, j] for i, j in enumerate(p)) - langid.PENALTY * sum(x != y for x, y in zip(p, p[1:]))

        best = max(value(p) for p in itertools.product(range(3), repeat=b - a))
        assert abs(value(tuple(path[a:b])) - best) < 1e-6
        changed += len(set(path[a:b].tolist())) > 1
    assert changed > 3


def test_ties_repeats_and_long_texts_of_languages(spark):
    docs = spark.createDataFrame([(i, "abc abd" if i % 2 else "xyz xyw", "p" if i % 2 else "q") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    long = "abc abd " * 60_000 + "xyz xyw " * 60_000
    rows = [(1, "mmm"), (2, long), (3, "abc"), (3, "abc"), (4, long)]
    got = sorted(tuple(x) for x in langid.predict(table(spark, rows), model).collect())
    assert [x[0] for x in got] == [1, 2, 3, 3, 4] and got[2] == got[3] and got[1][1:] == got[4][1:] and got[1][3:] == (240_000, 2)
    assert got[0][1] == "p"  # neither language has seen it: first in byte order
