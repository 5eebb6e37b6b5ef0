"""Encoding, fill-in-middle and alignment of tokenizers against the libraries and plain versions."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from helpers import SMALL
from kindler.llm import cross_align, fim, piece_encoding, queries, units
from kindler.llm import textkernel as K

PIECES, BYTES = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
ODD = ["a", "b", "Z", " ", " ", "\t", "\n", "\r", ".", "'s", "<", "é", "ß", "漢", "▁", " ", "　", "ﬁ", "①", "が", "²", "​", "😀", "👨‍👩‍👧", "Å", "¨", "\0", "﻿", "�", "ｱ", "ﾞ", "각", "1", "23"]


def strange(n=600, seed=3):
    r = random.Random(seed)
    fixed = ["", " ", "  ", "▁", "▁▁ ", " a", "a ", " a  b ", "<s>", "</s> x", "<unk>", "<0x41>", "<|endoftext|> x", "\n", "a　 b", "¨ ¨", "x" * 5000, "it's  ", "   a", "<P>", "a<S", "<S>b", "<M> c"]
    return fixed + ["".join(r.choice(ODD) for _ in range(r.randint(1, 40))) for _ in range(n)]


def number(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def with_rules(rule, dummy, reduce):
    """The model with the character map and white-space rules of another normaliser."""
    made = dict(piece_encoding.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()))
    own = b"\x12" + number(len(made[2])) + made[2] + b"\x18" + bytes([dummy]) + b"\x20" + bytes([reduce])
    with open(PIECES, "rb") as f:
        return f.read() + b"\x1a" + number(len(own)) + own


@pytest.mark.parametrize("rules", [None, *((rule, d, e) for rule in ("nmt_nfkc", "nfkc_cf", "identity") for d in (0, 1) for e in (0, 1))])
def test_pieces_spans_and_decoding_equal_the_library(rules):
    data = with_rules(*rules) if rules else open(PIECES, "rb").read()
    library, model, texts = sentencepiece.SentencePieceProcessor(model_proto=data), piece_encoding.Model(data=data), strange()
    ids, first, begins, ends = piece_encoding.PieceEncoder(model).encode(*K.offsets_of(pa.array(texts, pa.string())))
    back = piece_encoding.PieceDecoder(model).decode(ids, first)
    for i, text in enumerate(texts):
        own = slice(first[i], first[i + 1])
        want = library.encode(text, return_type="proto").pieces
        assert ids[own].tolist() == [p.id for p in want] == library.encode(text)
        assert list(zip(begins[own].tolist(), ends[own].tolist(), strict=True)) == [(p.begin, p.end) for p in want]
        assert back[i] == library.decode(ids[own].tolist())


def test_any_ids_decode_as_in_the_library():
    r, library, model = random.Random(8), sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_encoding.Model(PIECES)
    rows = [[r.choice([0, 1, 2, 3 + r.randrange(256), r.randrange(32000), 29871, 259]) for _ in range(r.randint(0, 9))] for _ in range(3000)]
    first = np.cumsum([0, *map(len, rows)])
    assert piece_encoding.PieceDecoder(model).decode(np.array([i for x in rows for i in x]), first) == [library.decode(x) for x in rows]


def test_models_without_byte_fallback_are_refused():
    with open(PIECES, "rb") as f:
        data = f.read()
    with pytest.raises(ValueError):
        piece_encoding.Model(data=data + b"\x12\x03\x98\x02\x00")


def test_units_are_forgotten_and_learnt_again(monkeypatch):
    texts, library = strange(300, 9), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = piece_encoding.PieceEncoder(piece_encoding.Model(PIECES))
    encoder.cache.keep = 5
    for part in (texts[:100], texts[100:], texts[:50]):
        ids, first, *_ = encoder.encode(*K.offsets_of(pa.array(part, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [library.encode(t) for t in part]


def test_byte_level_units_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    texts = [" " + t for t in strange()] + ["no space first", "x \n\n  y", "   z", "don't  'll "]
    ids, first = units.ByteLevelEncoder(BYTES).encode(*K.offsets_of(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def rows_of(spark, docs):
    """With clashing column names, in several partitions."""
    return spark.createDataFrame([(d, t, [1], "x", 2) for d, t in docs], "doc_id long, text string, ids array<int>, form string, block int").repartition(3)


def every(docs):
    return [*docs, (1, None), (1, None), (None, "a null id"), (None, None), (9, "same"), (9, "same"), *((1000 + i, t) for i, t in enumerate(strange(200, 4)))]


def test_piece_operator_on_awkward_rows(spark, docs):
    library, given = sentencepiece.SentencePieceProcessor(model_file=PIECES), every(docs)
    made = piece_encoding.decode(piece_encoding.encode(rows_of(spark, given), PIECES), PIECES)
    key = lambda x: (x[0] is None, x)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"]), r["decoded"]) for r in made.collect()), key=key)
    assert got == sorted(((-1 if d is None else d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in given), key=key)
    assert piece_encoding.encode(rows_of(spark, given).where("false"), PIECES).count() == 0


def test_automaton_against_patterns():
    texts = strange(900, 6) + ["".join(random.Random(i).choice("ab<>PSM \n é漢😀") for _ in range(n)) for i, n in enumerate((511, 512, 513, 3000))]
    offs, raw = K.offsets_of(pa.array(texts, pa.string()))
    flags = fim.scan(offs, raw)
    for t, a, b in zip(texts, offs[:-1], offs[1:], strict=True):
        own, size = flags[a:b], lambda i, t=t: len(t[:i].encode())
        assert int((own & fim.CHARACTER).sum()) == len(t)
        assert np.flatnonzero(own & fim.UNIT).tolist() == [size(m.start()) for m in brute.UNIT.finditer(t)]
        assert np.flatnonzero(own & fim.SENTINEL).tolist() == [size(m.end()) - 1 for m in re.finditer("<[PSM]>", t)]


@pytest.mark.parametrize("percent", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_fill_in_middle_and_back(spark, docs, percent):
    given = every(docs)
    made = fim.transform(rows_of(spark, given), 42, *percent)
    got = fim.restore(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    want = [(d, *brute.fill_in_middle(d, t, 42, *percent), t or "") for d, t in given]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert fim.transform(rows_of(spark, given).where("false")).count() == 0


def both():
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_alignment_on_awkward_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(cross_align, "BLOCK", 3000)
    given = every(docs)
    got = cross_align.link_figures(rows_of(spark, given), BYTES, PIECES).collect()
    want = [(*r[:7], brute.sha(r[7]) if r[7] is not None else "") for r in brute.cross_alignment(given, *both())]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(not r[1] for r in want) and any(r[5] != r[4] for r in want)
    assert cross_align.link_figures(rows_of(spark, given).where("false"), BYTES, PIECES).count() == 0
    assert cross_align.link_figures(rows_of(spark, [(1, None), (2, "▁")]), BYTES, PIECES).select("n_a", "count_sum", "groups_sha256").distinct().collect() == [(0, 0, "")]


def test_cuts_are_common_ends(spark):
    tokenizer, pieces = both()
    text = "Tokenisers disagree:\n\n  naïve 12345 漢字!"
    r = cross_align.align(rows_of(spark, [(1, text), (2, None), (3, "")]), BYTES, PIECES).where("doc_id = 1").first()
    assert list(r["a_ids"]) == tokenizer.encode(" " + text, add_special_tokens=False).ids and list(r["b_ids"]) == pieces.encode(text)
    [(_, _, _, n, *_, groups)] = brute.cross_alignment([(1, text)], tokenizer, pieces)
    assert len(r["cuts"]) == n == groups.count(";") + 1 and r["cuts"][-1] == len((" " + text).encode())


@pytest.mark.parametrize("name", ["op11_piece_encoding", "op13_cross_alignment"])
def test_whole_query_against_the_libraries(spark, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    tokenizer, pieces = both()
    if name.startswith("op11"):
        want = [(d, len(i), brute.sha(",".join(map(str, i))), brute.sha(pieces.decode(i))) for d, t in rows for i in [pieces.encode(t or "")]]
    else:
        want = [(*r[:7], brute.sha(r[7]) if r[7] is not None else "") for r in brute.cross_alignment(rows, tokenizer, pieces)]
    df = queries.queries()[name](spark, SMALL)
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert {f.name: f.dataType.simpleString() for f in df.schema}["doc_id"] == "bigint"
    assert df.select(F.count_distinct("doc_id")).first()[0] == len({d for d, _ in rows})
