"""BPE by transducer against the tokenizers library, and the transducer against a plain dictionary."""

import hashlib
import random

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from tabularium.llm import bpe, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(bpe.default_vocabulary())
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.default_vocabulary())


def odd_texts(n):
    rng = random.Random(8)
    parts = ["a", "b", " ", " ", "\n", "'s", "'", "1", "é", "　", "<|endoftext|>", ".", "the", "日", "\x1f", "\x85", "\xa0", "՘", "\x00", "😀", "́", " "]
    fixed = ["", " ", "  ", "a  b", "a \n b", "  \n b", " end ", "x<|endoftext|>y <|endoftext|", "don't 'tis ''t 's", "ab" * 3000, "\x00 \x00", "१२३ 123"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def expected(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)


def test_encoding_of_the_given_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.op12_bpe_transducer(spark, sf_dir)) == sorted((expected(library, *d) for d in docs), key=str)


def test_encoding_of_odd_rows(spark, tmp_path, library):
    rows = [*enumerate(odd_texts(400)), (None, "no id"), (None, None), (3, None), (3, "word " * 50_000), (3, "word " * 50_000), (900, "x" * 200_000)]
    spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(queries.op12_bpe_transducer(spark, str(tmp_path))) == sorted((expected(library, *r) for r in rows), key=str)


def test_ids_are_a_table_that_is_decoded_later(spark, library):
    rows = [(i, t) for i, t in enumerate(odd_texts(60))] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    name = bpe.lexicon(docs, words=40)
    held = bpe.encode(docs, name)
    back = {r.doc_id: (r.ids, r.text) for r in bpe.decode(held.unionByName(spark.createDataFrame([(100, None)], "doc_id long, ids array<int>")), name).collect()}
    assert back == {**{i: (library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows}, 100: (None, "")}
    assert {r.doc_id: (r.ids, r.text) for r in bpe.round_trip(docs, name).collect()} == {k: v for k, v in back.items() if k < 100}


def test_encoding_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op12_bpe_transducer(spark, str(tmp_path)).count() == 0


def test_words_are_counted_over_all_texts(spark):
    texts = [t for t in odd_texts(200) if t]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(2, None)], "doc_id long, text string")
    plain, pieces = {}, bpe.Pieces(bpe.odd_letters())
    for t in texts:
        for part in t.split("<|endoftext|>"):
            for p in pieces(part):
                plain[p] = plain.get(p, 0) + 1
    assert {r.word: r.n for r in bpe.word_counts(docs, ["<|endoftext|>"]).collect()} == plain


def test_letters_are_those_of_the_library(library):
    pieces, split = bpe.Pieces(bpe.odd_letters()), library.pre_tokenizer.pre_tokenize_str
    for c in [*range(0, 0x3000, 7), *range(0x3000, 0xD800, 97), 0x558, 0x88F, 0x1680, 0x2028, 0x2EBF0, 0x11DE0, 0xE000, 0x10FFFF]:
        text = "a" + chr(c) + "b1" + chr(c) + "1 " + chr(c) + "!" + chr(c)
        assert [text[a:b] for _, (a, b) in split(text)] == pieces(text), hex(c)


def test_transducer_is_minimal_and_exact(vocabulary, tmp_path):
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    outs = {w: tuple(rng.randrange(3) for _ in range(rng.randrange(1, 4))) for w in words}
    states, first = bpe.transducer((w, outs[w]) for w in words)
    assert len(set(states)) == len(states)  # no two states alike: with outputs in front this is the least automaton
    # plain minimal automaton: states are the residual functions, after the outputs that all continuations share are taken away
    def residual(prefix):
        rest = {w[len(prefix) :]: outs[w] for w in words if w.startswith(prefix)}
        values = list(rest.values())
        k = 0
        while all(len(v) > k for v in values) and len({v[k] for v in values}) == 1:
            k += 1
        return frozenset((w, v[k if prefix else 0 :]) for w, v in rest.items())

    assert len(states) == len({residual(w[:i]) for w in words for i in range(len(w) + 1)})
    (tmp_path / "x.bin").write_bytes(bpe.compiled(((w, outs[w]) for w in words), vocabulary))
    held = bpe.Lexicon(str(tmp_path / "x.bin"))
    others = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 8))) for _ in range(2000)]
    known, ends, ids = held.walk([*words, *others])
    assert known.tolist() == [w in outs for w in [*words, *others]]
    assert [tuple(ids[a:b]) for a, b in zip(ends, ends[1:])] == [outs.get(w, ()) for w in [*words, *others]]


def test_merges_by_list_and_heap_agree(vocabulary, library):
    merge, rng, words = bpe.Merger(vocabulary.singles, vocabulary.merges), random.Random(6), ["", "a"]
    for _ in range(800):
        word = "".join(rng.choice("theinaouszé") for _ in range(rng.randrange(1, 60)))
        ids = library.encode(word, add_special_tokens=False).ids
        assert merge(word.encode()) == merge._by_heap([vocabulary.singles[b] for b in word.encode()]) == ids
        words.append(word)
    assert [np.frombuffer(x, np.int32).tolist() for x in merge.many([w.encode() for w in words])] == [merge(w.encode()) for w in words]


def test_ids_do_not_depend_on_the_lexicon(vocabulary, tmp_path, library):
    (tmp_path / "none.bin").write_bytes(bpe.compiled([], vocabulary))
    held = bpe.Lexicon(str(tmp_path / "none.bin"))
    for text in odd_texts(50):
        ids = held.encode([text])[0]
        assert ids.dtype == np.int32 and ids.tolist() == library.encode(text, add_special_tokens=False).ids and held.decode(ids.tolist()) == text
    assert regex.fullmatch(bpe.PATTERN, " word")


def test_each_word_is_looked_up_once(vocabulary, tmp_path, library):
    """A unit of one word is held as that, not as a word besides; marks behind it don't make it another word."""
    (tmp_path / "few.bin").write_bytes(bpe.compiled([(b" known", (7,))], vocabulary))
    held, asked = bpe.Lexicon(str(tmp_path / "few.bin")), []
    made = held._made
    held._made = lambda pieces: asked.extend(pieces) or made(pieces)
    texts = ["Begin strangeword, strangeword. other", "Begin other! strangeword known.", "strangeword"]
    found = held.encode(texts[:2]) + held.encode(texts[2:] + texts[:1])
    assert sorted(asked) == sorted(["Begin", " strangeword", ",", ".", " other", "!", " known", "strangeword"])
    assert not {w for w in (*held.words.now, *held.words.before) if w.startswith(" ")}
    want = [library.encode(t, add_special_tokens=False).ids for t in (*texts, texts[0])]
    known = library.encode(" known", add_special_tokens=False).ids
    at = next(i for i in range(len(want[1])) if want[1][i : i + len(known)] == known)
    want[1][at : at + len(known)] = [7]
    assert [x.tolist() for x in found] == want


def test_units_and_tokens_side_by_side(vocabulary, tmp_path, library):
    texts, pieces = odd_texts(400), bpe.Pieces(bpe.odd_letters())
    first, rest = bpe.units(texts)
    for text, begins, others in zip(texts, first, rest.to_pylist()):
        assert begins + "".join(" " + u for u in others or []) == text
        assert pieces(begins) + [p for u in others or [] for p in pieces.after_blank(u)] == pieces(text)
    (tmp_path / "none.bin").write_bytes(bpe.compiled([], vocabulary))
    held, rng = bpe.Lexicon(str(tmp_path / "none.bin")), random.Random(9)
    rows = [[rng.choice(sorted(vocabulary.tokens)) for _ in range(rng.randrange(9))] for _ in range(300)] + [[5] * 300_000]  # also bytes that are no UTF-8
    got = held.decode_many(np.array([i for r in rows for i in r], np.int32), np.cumsum([0, *map(len, rows)]))
    long = "some words of a text " * 40_000 + "<|endoftext|> and  more"  # more units than are gathered together
    assert held.encode(["a b", long, ""])[1].tolist() == library.encode(long, add_special_tokens=False).ids
    assert got == [held.decode(r) for r in rows] == [library.decode(r, skip_special_tokens=False) for r in rows]
