"""SentencePiece encoding against the library itself."""

import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from isochron.llm import pieces, queries
from tests.llm import brute

PATH = pieces.model_file()
ODD = [None, "", " ", "   ", "▁", "▁▁ ▁", " lead", "trail ", "two  spaces", "a▁b", "tab\tand\nnewline", "0\0null", "é ß 漢字 🙂🙂", "<s> </s> <unk> <0x41>", "x" * 5000, "mixed " * 3000, "​ zero", "ﬁ ½ Å", "  a  b  "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def told(library, text):
    ids = [*library.encode(text or ""), library.eos_id()]
    return len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids))


def spans_told(library, text):
    """Spans by laying what each piece spells over the text, one piece at a time."""
    data, at, starts, ends = text.encode(), -1 if text else 0, [], []
    for i in library.encode(text):
        starts.append(max(at, 0))
        at += 1 if library.is_byte(i) else len(library.id_to_piece(i).replace("▁", " ").encode())
        ends.append(max(at, 0))
    return brute.sha(struct.pack(f"<{2 * len(starts) + 2}q", *starts, len(data), *ends, len(data)))


def test_whole_table(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.queries()["op10_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == told(library, texts[r["doc_id"]])
        assert r["spans_sha256"] == spans_told(library, texts[r["doc_id"]] or "") and r["n_spanned"] == len((texts[r["doc_id"]] or "").encode())


def test_odd_texts_keep_rows_and_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "x")], "doc_id bigint, text string, ids string")
    got = pieces.pieces_report(docs).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted((i, *told(library, t)) for i, t in [*enumerate(ODD), (0, None)])
    encoded = pieces.decode_ids(pieces.encode_texts(docs, PATH), PATH)
    assert encoded.columns == [*docs.columns, "__ids", "__starts", "__ends", "__decoded"]
    for r in encoded.collect():
        assert r["__ids"] == [*library.encode(r["text"] or ""), library.eos_id()] and r["__decoded"] == library.decode(r["__ids"])
    assert pieces.pieces_report(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9é漢🙂▁\n\t.-"), max_size=40))
def test_ids_and_spans_of_any_text(text):
    model = pieces.codec(PATH)
    data = text.encode()
    ids, starts, ends = model.spans(data)
    assert ids == [*model.library.encode(text), model.end]
    assert starts[0] == 0 and ends[-1] == len(data) and starts[1:].tolist() == ends[:-1].tolist() and all(a <= b for a, b in zip(starts, ends, strict=True))
    spelt = [b"" if i == model.end else model.text_of[i] for i in ids]
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        assert data[a:b].replace("▁".encode(), b" ") == (spelt[k][1:] if k == 0 and data else spelt[k])


def hand_made_map():
    """A trie made by hand: A gives a, AB gives xyz."""
    units = [0] * 2048
    units[0] = 256 << 10
    a = 256 ^ 65
    units[a] = 65 | 1 << 8 | 512 << 10
    units[a ^ 512] = 0x80000000 | 0
    ab = a ^ 512 ^ 66
    units[ab] = 66 | 1 << 8 | 1024 << 10
    units[ab ^ 1024] = 0x80000000 | 2
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"a\0xyz\0"


def test_character_map_takes_the_longest_prefix():
    plain, source = pieces.CharacterMap(hand_made_map()).normalise("AéABB".encode())
    assert (plain, source.tolist()) == ("aéxyzB".encode(), [0, 1, 2, 3, 3, 3, 5, 6])
    plain, source = pieces.CharacterMap(b"").normalise(b"AB")
    assert (plain, source.tolist()) == (b"AB", [0, 1, 2])


def test_a_model_with_a_compiled_map(tmp_path):
    """The library reads the same map: ids are its own, and spans point behind the replacements."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.name = "made"
    model.normalizer_spec.precompiled_charsmap = hand_made_map()
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    codec = pieces.Codec(path)
    for text in ("", "A", "AB", "the AB  A é漢 AAB tail ", "ABAB" * 50):
        ids, starts, ends = codec.spans(text.encode())
        mapped = text.replace("AB", "xyz").replace("A", "a")
        assert ids == [*codec.library.encode(text), codec.end]
        assert codec.decode(ids) == codec.library.decode(codec.library.encode(mapped))
        assert starts[0] == 0 and ends[-1] == len(text.encode()) and starts[1:].tolist() == ends[:-1].tolist() and (starts <= ends).all()
    # A piece over the middle of "xyz" begins where AB begins, and the next edge is behind it.
    ids, starts, ends = codec.spans(b"q AB q")
    assert {int(x) for x in starts} <= {0, 1, 2, 4, 5, 6}
