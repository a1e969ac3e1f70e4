"""Operators 1, 4 and 9: against the libraries, exact round trips, and what packing promises."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyarrow import fs
from tokenizers import Tokenizer

from ledgerloom.llm import packing, piece_bpe, token_files, word_bpe
from ledgerloom.llm.common import fresh_folder
from ledgerloom.llm.word_bpe import encoder

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "\n", " \n ", "a  b", " a", "▁a ▁", "日本語 é́ 😀", "<s> </s> <0x0A> <|endoftext|>", "\x00\x01\x1c", "don't İSTANBUL ǅ", " " * 99 + "b" + " " * 50, "abcde" * 3000, "x y z's\t\tq " * 40, "a\u00a0b\u2028c"]


def random_texts(n, alphabet):
    rnd = random.Random(5)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 50))) for _ in range(n)]


def test_pieces_are_the_library_s():
    model, library = piece_bpe.piece_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ODD + random_texts(4000, " \nabehrtn.,▁é日!") + random_texts(2000, ["the", " ", "  ", "er", "ing", "\n", "!!", "▁"]):
        ids = library.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)


def test_decoding_any_ids():
    model, library, rnd = piece_bpe.piece_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    for _ in range(2000):
        ids = [rnd.randrange(3, 259) if rnd.random() < 0.5 else rnd.randrange(32000) for _ in range(rnd.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(piece_bpe, "PART", 50)
    model, library = piece_bpe.piece_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "the quick  brown\nfox jumps over " * 30
    assert model.encode(text) == library.encode(text)


def test_runs_of_spaces_across_cuts(monkeypatch):
    monkeypatch.setattr(piece_bpe, "PART", 50)
    model, library = piece_bpe.piece_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for n in range(1, 41):
        for before in range(10, 50):
            text = "a" * before + " " * n + "the end" + " " * n + "\n" + " " * n + "b  c" + "   d" * 20
            assert model.encode(text) == library.encode(text), (n, before)
    assert model.encode(" " * 500) == library.encode(" " * 500)


def test_piece_digests(spark, docs):
    texts = [*ODD, None, ODD[5]]
    rows = {(r.doc_id): r for r in piece_bpe.encode_digests(docs(list(enumerate(texts[:-1])) + [(None, texts[-1])]), PIECES).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for k, text in [*enumerate(texts[:-1]), (None, texts[-1])]:
        ids = library.encode(text or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == want
    found = piece_bpe.encode_column(docs([(1, "the end")]), PIECES).first()
    assert (found.ids, found.decoded) == (library.encode("the end"), "the end")
    assert piece_bpe.encode_digests(docs([]), PIECES).count() == 0


def test_words_are_the_library_s():
    own, library = encoder(WORDS), Tokenizer.from_file(WORDS)
    for text in ODD + random_texts(3000, "aAzZéÉßñœŒİıÿɏ.,!'s &%1×ª<|\n\t") + random_texts(500, ["don't", " ", "THE", "end.", "<|endoftext|>", "x"]):
        assert np.frombuffer(own.encode(text), own.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_read_back(spark, docs):
    texts = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (99, None)]
    random.Random(1).shuffle(texts)
    folder = fresh_folder(spark, "tokens")
    manifest = token_files.write_tokens(docs(texts), folder, WORDS, end_id=1, partitions=3)
    library = Tokenizer.from_file(WORDS)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for doc, text in order:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in token_files.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == want and manifest["n_tokens"] == at and manifest["n_docs"] == len(texts)
    part = token_files.TokenPart(folder, manifest["parts"][0], manifest["width"])
    assert part[0].tolist()[-1] == 1 and isinstance(part.tokens, np.memmap)


def test_token_files_of_an_empty_table(spark, docs):
    folder = fresh_folder(spark, "tokens")
    token_files.write_tokens(docs([]), folder, WORDS, end_id=1)
    assert token_files.read_digests(spark, folder).count() == 0


@pytest.mark.parametrize("capacity", [64, 256])
def test_packing_places_each_id_once(spark, docs, prose, capacity):
    rnd = random.Random(capacity)
    texts = [(k, " ".join(t.split()[: rnd.randint(0, 60)])) for k, t in enumerate(prose(150, 60))] + [(200, None), (5, "twice"), (None, "null id"), (300, " ".join(prose(1, 900)))]
    rows = packing.pack(docs(texts), WORDS, end_id=2, capacity=capacity, grain=4).collect()
    library = Tokenizer.from_file(WORDS)
    sequences, total = defaultdict(list), 0
    want = sorted((doc is not None, doc or 0, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for doc, t in texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == want
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    # each document's pieces cover its ids, each once; the rows of id 5 are told apart by their lengths
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    encoded = [(doc, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for doc, t in texts]
    assert set(of) == {(doc, len(ids)) for doc, ids in encoded} and len(of) == len(texts)
    for doc, ids in encoded:
        at = 0
        for start, length, crc in sorted(of[doc, len(ids)]):
            assert start == at and length > 0 and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert total == sum(w[2] for w in want) and sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.25 * total / capacity + 2
    assert packing.pack(docs([]), WORDS, end_id=2).count() == 0


def test_patterns_use_every_item_and_few_sequences():
    rng = np.random.default_rng(3)
    sizes = np.array(sorted(rng.choice(np.arange(1, 129), 40, replace=False)))
    counts = rng.integers(1, 500, len(sizes))
    found = packing.patterns_for(counts, sizes, 128)
    assert (sum(p * n for p, n in found) == counts).all() and all((p * sizes).sum() <= 128 for p, _ in found)
    # a proven bound (Martello and Toth's): items above 128 - e fill a sequence alone, those below e count nothing
    bound = max(counts[sizes > 128 - e].sum() + (counts * sizes)[(sizes >= e) & (sizes <= 128 - e)].sum() / 128 for e in range(65))
    assert sum(n for _, n in found) <= 1.01 * bound + len(sizes)


def test_best_pattern_is_the_best():
    values, sizes = np.array([0.4, 0.55, 0.7]), np.array([3, 4, 5])
    best = max((a * 0.4 + b * 0.55 + c * 0.7) for a in range(5) for b in range(4) for c in range(3) if 3 * a + 4 * b + 5 * c <= 12)
    assert packing.best_pattern(values, sizes, 12)[0] == pytest.approx(best)


def test_words_dropped_while_others_are_learnt(prose, monkeypatch):
    """A text that holds words known before and new ones, when so many are known that all are dropped."""
    monkeypatch.setattr(word_bpe, "KEPT_WORDS", 20)
    coder = word_bpe.WordEncoder(WORDS)
    for text in [*prose(40, 30), *ODD, "日本語 a1 b2 c3", "a1 b2 日本語 d4"]:
        assert coder.encode(text) == coder.ids(text)


def test_ranges_of_files_that_cannot_be_mapped(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BUFFERED", 7)
    numbers = np.arange(100, dtype="<u4") * 3
    (tmp_path / "x").write_bytes(numbers.tobytes())
    found = token_files._mapped(fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "x", "<u4")
    assert isinstance(found, token_files.Ranges) and len(found) == 100 and found[40] == 120 and (found[:] == numbers).all()
    rnd = random.Random(1)
    for _ in range(200):
        a = rnd.randint(0, 100)
        b = rnd.randint(a, 100)
        assert found[a:b].tolist() == numbers[a:b].tolist()


def test_models_that_do_more_than_merge_are_refused(monkeypatch):
    monkeypatch.setattr(piece_bpe.PieceModel, "encode", lambda self, text: [1])
    with pytest.raises(ValueError, match="merging alone"):
        piece_bpe.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
