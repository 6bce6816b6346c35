import zlib

import numpy as np
import pytest
from llm_cases import ODD, prose, rows
from tokenizers import Tokenizer

from pagetree.llm.packing import END_ID, pack, piece_lengths
from pagetree.llm.tokens import vocabulary, word_ids

FILE = "word_bpe_49k.json"
TRICKY = [
    "It's DON'T 'S it 's", "Σίσυφος ΑΣ", "á ́b à", "x\x1cy z w\u0085q", "<|endoftext|> a<|endoftext|>b", "ÉÀ Ünï, façade. ß", "a,b..c!! 12 3.4", "İ ẞ ﬁ",
    "字 漢字かな", "‍‍ ‘quoted’ “q”", "MIXED Case, WORD?! end", "''' ''s 've've", "a\u0000b", "😀 😀",
]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(vocabulary(FILE))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_have_the_ids_of_whole_texts(whole):
    table = word_ids(vocabulary(FILE))
    for text in TRICKY:
        clean = text.encode("utf-8", "replace")
        assert np.frombuffer(table.of(clean), np.uint32).tolist() == whole(clean.decode()), text


def test_piece_lengths():
    for n in [1, 2, 3, 7, 8, 9, 100]:
        parts = piece_lengths(n, 8)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 8 for p in parts)
    assert piece_lengths(0, 8) == []


def test_round_trip(make, whole):
    docs = [*ODD, *[(20 + i, t) for i, t in enumerate(TRICKY) if "\ud83d" not in t], (90, prose(700)), (91, prose(700))]
    found = pack(make(*docs), FILE, longest=64).collect()
    expected = sorted([*whole(t[1]), END_ID] for t in docs)
    by = {}
    for r in found:  # repeated ids come apart by their text's tokens and place
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        ids = np.frombuffer(r.ids, np.uint32)
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64
    texts = []
    for (_, total), parts in by.items():
        seen = sum(p.length for p in parts) // total
        starts = {}
        for p in parts:
            starts.setdefault(p.start, []).append(p)
        assert all(len(v) == seen for v in starts.values())
        for k in range(seen):
            texts.append([i for s in sorted(starts) for i in np.frombuffer(starts[s][k].ids, np.uint32).tolist()])
    assert sorted(texts) == expected
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    for length in {r.length for r in found}:
        assert sorted(r.place for r in found if r.length == length) == list(range(sum(r.length == length for r in found)))


def test_empty_table(make):
    assert rows(pack(make(), FILE), "doc_id") == []
    with pytest.raises(ValueError):
        pack(make(), FILE, longest=100)


def test_registered_packing_has_the_ids_of_an_unchanged_tokenizer(spark, make, tmp_path):
    import corpus_pipeline
    from pagetree.llm import queries

    plain = Tokenizer.from_file(vocabulary(FILE))
    ids = lambda text: plain.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
    table = word_ids(vocabulary(FILE), special=True)
    assert ids("a<|endoftext|>b") == [320, 49407, 321]
    quoting = ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", "so: <|EndOfText|> or x<|startoftext|>. <|endoftext|>"]
    for text in [*TRICKY, *quoting]:
        assert np.frombuffer(table.of(text.encode("utf-8", "replace")), np.uint32).tolist() == ids(text), text
    docs = make(*enumerate(quoting))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for found in (queries.QUERIES["op4_packing"](spark, str(tmp_path)), corpus_pipeline.pack_pieces(spark, docs, "")):
        expected = []
        for i, text in enumerate(quoting):
            every, start = [*ids(text), END_ID], 0
            for n in piece_lengths(len(every), 4096):
                expected.append((i, start, n, zlib.crc32(np.array(every[start : start + n], np.uint32).tobytes()), len(every)))
                start += n
        assert rows(found, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(expected)
