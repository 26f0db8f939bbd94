"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from driftgate.llm import pieces
from driftgate.llm.queries import all_queries

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
PARTS = [
    " ", "  ", "   ", "\t", "\n", "a", "the", " the", "Hello", "ing", "é", "é", "日本", "🦄", "👩‍👩‍👧", "<s>", "</s>", "<unk>", "<0x41>", "▁",
    "▁▁", " ", "　", "ﬁ", "①", "ｶﾞ", "½", "​", "­", "\x00", "\x7f", "zqxjk", "1234", "...", "=====", "�", "ﷺ", "한글", "𝒜", " ٣",
]


def with_map(rule, squeeze=True, prefix=True, **trained):
    """The same pieces behind a compiled character map of the library."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    if rule:
        other = pb.ModelProto()
        other.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.normalizer_spec.add_dummy_prefix = prefix
    for key, value in trained.items():
        setattr(model.trainer_spec, key, value)
    if not model.trainer_spec.byte_fallback:
        for piece in model.pieces:
            if piece.type == pieces.BYTE:
                piece.type = pieces.NORMAL
    return model.SerializeToString()


def random_texts(n, seed, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]


def check(file, texts, spans=True):
    library, own = spm.SentencePieceProcessor(model_proto=file), pieces.Encoder(file)
    ids, begins, ends, edge = own.encode(pa.array(texts))
    decoded = own.decode(ids, edge)
    for i, text in enumerate(texts):
        a, b = edge[i], edge[i + 1]
        want = library.encode(text)
        assert ids[a:b].tolist() == want, text
        assert decoded[i] == library.decode(want), text
        if spans:
            proto = library.encode(text, return_type="proto")
            got = list(zip(begins[a:b].tolist(), ends[a:b].tolist()))
            assert got == [(p.begin, p.end) for p in proto.pieces], text


def test_random_texts():
    with open(PATH, "rb") as f:
        check(f.read(), random_texts(1500, 1) + ["", " ", "  ", "x"])


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze, prefix", [(True, True), (False, True), (False, False), (True, False)])
def test_character_maps(rule, squeeze, prefix):
    check(with_map(rule, squeeze, prefix), random_texts(500, 2) + ["", " ", "  a  ", " 　 x   "])


def test_spans_of_squeezed_text():
    check(with_map("nmt_nfkc"), ["  Hello   the world  ", "ｶﾞ ﬁne  ①", " a", "x 　 y "])


def test_without_byte_fallback():
    check(with_map("", False, byte_fallback=False), random_texts(500, 3))


def test_long_texts():
    with open(PATH, "rb") as f:
        check(f.read(), ["a" * 20_000, "ab" * 9_000, " " * 5_000, "".join(random_texts(1, 4, 9_000)), "🦄" * 3_000], spans=False)


def test_heap_and_list_agree(monkeypatch):
    monkeypatch.setattr(pieces, "FEW", 3)
    with open(PATH, "rb") as f:
        check(f.read(), random_texts(300, 7))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 100)
    with open(PATH, "rb") as f:
        file = f.read()
    own, library = pieces.Encoder(file), spm.SentencePieceProcessor(model_file=PATH)
    for text in random_texts(50, 5):
        assert own.encode(pa.array([text]))[0].tolist() == library.encode(text)


def test_decoding_odd_ids():
    with open(PATH, "rb") as f:
        own = pieces.Encoder(f.read())
    library, rng = spm.SentencePieceProcessor(model_file=PATH), random.Random(6)
    for _ in range(500):
        row = [rng.choice([0, 1, 2, 259, 260, 261, rng.randrange(3, 259), rng.randrange(32_000)]) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(row, np.int64), np.array([0, len(row)])) == [library.decode(row)], row


def test_bytes_that_are_no_text():
    raw = [b"a\xffb", b"\xe2\x96", b"ok", b"\xed\xa0\x80x"]
    with open(PATH, "rb") as f:
        own = pieces.Encoder(f.read())
    column = pa.array(raw, pa.binary()).cast(pa.large_binary()).view(pa.large_string())
    ids, begins, ends, edge = own.encode(column)
    library = spm.SentencePieceProcessor(model_file=PATH)
    for i, text in enumerate(raw):
        fixed = text.decode(errors="replace") if i != 3 else "�" * 3 + "x"
        fixed = "��" if i == 1 else fixed
        assert ids[edge[i] : edge[i + 1]].tolist() == library.encode(fixed)
        assert ends[edge[i + 1] - 1] == len(text)


def test_query_on_the_table(spark):
    library = spm.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = all_queries()["op13_sentence_pieces"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_cases(spark):
    rows = [(1, None, "x", 5), (2, "", "y", 6), (2, "", "y", 6), (3, " the  end", None, 7), (None, "a", "z", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded int")
    out = pieces.decode(pieces.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "begins", "ends", "decoded"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].ids == [1, 2] and got[1].decoded == "" and got[2].begins == [0, 0] and out.count() == 5
    assert got[3].decoded == " the  end" and got[3].ends[-1] == 9
    spans = list(zip(got[3].begins[1:-1], got[3].ends[1:-1]))
    assert "".join(" the  end"[a:b] for a, b in spans) == " the  end"
    assert pieces.encode(df, PATH, columns=("ids", "decoded")).collect() == out.select("doc_id", "text", "ids", "decoded").collect()
    bare = pieces.encode(df.select("text"), PATH, frame=False).filter("text = 'a'").first()
    assert bare.ids == spm.SentencePieceProcessor(model_file=PATH).encode("a")
    assert pieces.decode(pieces.encode(df.limit(0), PATH), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded == ""
