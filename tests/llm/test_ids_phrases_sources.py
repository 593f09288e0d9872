"""Token files, collocations and the divergence of sources against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_corpus_operators import docs, hard, lower, table  # noqa: F401
from tokenizers import Tokenizer

from tracegrain.llm import divergence, idcoder, idfiles, phrases, tokens
from tracegrain.llm.queries import tokenizer_path

CUTS = [("word_bpe_49k.json", tokens.WordCut), ("byte_bpe_50k.json", tokens.SpaceCut)]
PIECES = ["a", "The", "den.", "x,", "..", ",", "é.", "e\u0301", "T\u0308", "İ", "ß", "K", "Σ", "'s", "don't", "12.5", "<|endoftext|>", "<|", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "\x1f", "日本", "\U0001f600", "\x00"]


@pytest.mark.parametrize("name,cut", CUTS)
def test_encoder(name, cut):
    whole = Tokenizer.from_file(tokenizer_path(name))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.text(max_size=30), st.none()), max_size=5))
    def same(texts):
        ids, counts = tokens.encoder(tokenizer_path(name), cut).encode(pa.array(texts, pa.string()))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    same()


def test_encoder_notices_a_tokenizer_it_is_not_for():
    with pytest.raises(ValueError):
        tokens.Encoder(tokenizer_path("byte_bpe_50k.json"), tokens.WordCut()).encode(pa.array(["Two words here"]))


def test_plain_words_go_to_the_model_alone():
    """Folding and parting each new word anew takes the library three times as long as its merges do."""

    class Model:
        def __init__(self, whole):
            self.model = whole.model

    e = tokens.Encoder(tokenizer_path("word_bpe_49k.json"), tokens.WordCut(), fresh=0)
    whole = e.tokenizer
    texts = ["It's a Plain-text (12 km), we'll 'stay'...", "École ÉCOLE Straße ýñÿ 3x4 ß", "user@host.example/a_b?c=%41 ''s 't don'T", "\u00aa \u00b5m \u00a0x \u00b2 e\u0301 4×5÷6"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    e.tokenizer = Model(whole)
    ids, counts = e.encode(pa.array(texts[:3]))
    assert counts.tolist() == [len(w) for w in want[:3]] and ids.tolist() == [i for w in want[:3] for i in w]
    e.tokenizer = whole  # other letters and white space still go through all of it
    assert e.encode(pa.array(texts[3:]))[0].tolist() == want[3]


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 255, 256, 257, 1023, 5000, 70000])
def test_coder(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 49408, n), r.zipf(1.3, n) % 500, np.zeros(n, int), np.arange(n) % 7, np.arange(n)[::-1] % 49408):
        ids = ids.astype(np.int32)
        block = idcoder.block_length(n)
        coded = idcoder.encode(ids, 49408, block)
        assert len(coded) == -(-n // block) and (idcoder.decode(coded, n, 49408, block) == ids).all()
        for k in range(len(coded)):  # every block by itself
            part = ids[k * block : (k + 1) * block]
            assert (idcoder.decode(coded[k : k + 1], len(part), 49408, block) == part).all()


def test_coder_learns():
    ids = np.tile(np.random.default_rng(1).integers(0, 49408, 64), 64)
    assert sum(map(len, idcoder.encode(ids.astype(np.int32), 49408, 1024))) < len(ids)  # of two bytes each
    with pytest.raises(ValueError):
        idcoder.encode(np.array([7], np.int32), 7, 256)


def _want(rows):
    tok, at, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0, []
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return want


def test_token_files(table):  # noqa: F811
    got = sorted(map(tuple, idfiles.round_trip(table, tokenizer_path("word_bpe_49k.json"), files=3).collect()), key=lambda x: x[1])
    rows_ = sorted(((r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert got == _want(rows_)  # rows with one id have one text here, so their order is no matter


def test_files_can_be_read_in_parts_and_notice_damage(spark, docs, tmp_path):  # noqa: F811
    files = idfiles.write_ids(docs, tokenizer_path("word_bpe_49k.json"), files=2, folder=str(tmp_path / "ids")).orderBy("part").collect()
    path, n = files[0].path, files[0].ids
    whole = np.concatenate([ids for _, ids in idfiles.read_documents(path)])
    assert len(whole) == n
    for a, b in ((0, n), (5, 6), (n // 3, n // 2), (n - 1, n), (7, 7)):
        assert (idfiles.read_ids(path, a, b) == whole[a:b]).all()
    raw = bytearray(open(path, "rb").read())
    for at in (2, 20, len(raw) // 2, len(raw) - 60, len(raw) - 2):
        raw[at] ^= 4
        (tmp_path / "bad").write_bytes(raw)
        with pytest.raises(idfiles.Damaged):
            list(idfiles.read_documents(str(tmp_path / "bad")))
        raw[at] ^= 4


def test_a_long_document(spark):
    text = "the long text of it all goes on, " * 40000
    got = idfiles.round_trip(spark.createDataFrame([(1, "x"), (2, text), (3, None)], "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"), files=2).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == _want([(1, "x"), (2, text), (3, None)])


def _phrases(rows, least=30, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, c in f.items():
        found, around = [], Counter()
        for g, a in c.items():
            if a >= least:
                for n in range(2, len(g)):
                    for i in range(len(g) - n + 1):
                        around[g[i : i + n]] = max(around[g[i : i + n]], a)
        for g, a in c.items():
            if len(g) > 1 and a >= least and 100 * around[g] < 80 * a:
                score, _, l, r = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), a, l, r))
        for i, (score, _, g, a, l, r) in enumerate(sorted(found)[:top], 1):
            yield lang, i, g.decode(), a, l, r, total[lang], -score


@pytest.mark.parametrize("routed", [phrases.ROUTED, 160])
def test_phrases(table, routed):  # noqa: F811
    """With few words a route, many leading pairs are hot and dealt by all their words."""
    got = phrases.collocations(table, least=5, top=40, routed=routed)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(_phrases([(r.lang, r.text) for r in table.select("lang", "text").collect()], 5, 40))


def test_quicksort():
    r = np.random.default_rng(5)
    for size in (0, 1, 40, 3000):
        keys = r.integers(1, 6, (4, size)).astype(np.uint64)
        for d in range(1, 4):
            keys[d:, r.random(size) < 0.2] = 0
        n, free = r.integers(1, 4, size), r.random(size) < (0.01 if size < 3000 else 0)
        out = phrases.quicksort(keys, n, 30, free)
        for length in range(1, 5):
            want, open_ = Counter(), set()
            for i in range(size):
                g = tuple(keys[:length, i].tolist())
                if 0 not in g:
                    want[g] += int(n[i])
                    open_ |= {g} if free[i] else set()
            got = {tuple(keys[:length, i].tolist()): c for i, c, _ in zip(*out[length - 1], strict=True)}
            assert got == {g: c for g, c in want.items() if c >= 30 or g in open_}


def _audit(rows, least=3, top=200):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    docs_, n = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, text in rows:
        docs_[lang or ""].update(set(term(text)))
        n[lang or ""][source or ""].update(term(text))
    for lang, groups in n.items():
        kept = [t for t, d in docs_[lang].items() if d >= least]
        v, whole = len(kept), Counter()
        for c in groups.values():
            whole.update({t: c[t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            more = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(more)[:top])):
                yield from ((lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(found, 1))


def test_divergence(table):  # noqa: F811
    rows_ = table.withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("s"), F.col("doc_id") % 7)))
    got = divergence.audit(rows_)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(_audit([(r.lang, r.source, r.text) for r in rows_.select("lang", "source", "text").collect()]))


def test_divergence_of_many_sources_with_common_terms(spark):
    r = np.random.default_rng(4)
    rows_ = [("x", f"s{i}", " ".join(f"w{chr(97 + k)}" for k in r.zipf(1.5, 60) % 20 for _ in range(1 + i % 3))) for i in range(40)]
    rows_ += [("only", "a", "once"), ("only", "b", None), ("", "", "")]
    got = divergence.audit(spark.createDataFrame(rows_, "lang string, source string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(_audit(rows_))


def test_shares_are_exact():
    n, whole = np.array([0, 5, 10**12, 3 * 10**12]), np.array([1, 7, 10**12 + 1, 9 * 10**14])
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), whole.tolist(), strict=True)]
