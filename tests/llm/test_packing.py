import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import empty, frame, hard_documents
from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def counted(lengths, capacity):
    return np.bincount(np.array(lengths, int), minlength=capacity + 1)


def plain_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, free in enumerate(bins) if free >= length]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= length
        else:
            bins.append(capacity - length)
    return len(bins)


def fewest(lengths, capacity):
    """By trying all placements."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                go(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def check_places(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a  b", "a \n b", "x  y", "tab\t z ", "one two  three\n\nfour  ", "it's 'll don't <|endoftext|> end", "\x1c a\x1f b", "é ü　 z", "word " * 3000, " " * 20000 + "x", "q" * 5000])
def test_ids_like_the_tokenizer(tokenizer, text):
    encoder = packing.Encoder(PATH)
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_with_marks_and_line_ends_are_put_together_from_parts(tokenizer):
    """Words with other marks or line ends at words met before ask nothing of the tokenizer; ids are its own for strings of all kinds."""
    encoder = packing.Encoder(PATH)
    encoder.encode("start " + "Over the hill, früher war 12 (and over a-b_c")
    asked = []
    ids = encoder.ids
    encoder.ids = lambda text: asked.append(text) or ids(text)
    text = "start Over, the. hill... (and),\nOver the\nhill früher 12% a-b_c; over.\nWar..\nOver"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert asked == ["start"]
    draw = random.Random(9)
    parts = ["and", "Über", "ñandú", "'s", "'", "...", "<|endoftext|>", "\n", "\n\n", "\r\n", "12", "٣", "²", "ª", "_", "\u0250", "日本", "\x1c", "\t", "é", "é", "ǆ", "\u00d7", "``", "\x00", "ſ", "😀", "-", "(", " "]
    texts = [" ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    texts += [" " + chr(i) + "a" + chr(i) + chr(i) + " b" for i in range(0x300)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces(spark, tokenizer):
    rows = [*hard_documents(), (20, "a b c d e f g")]
    got = packing.pieces(frame(spark, rows), PATH, 64, with_ids=True).collect()
    want = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 64 + 1
        cuts = [ids[:first]] + [ids[i : i + 64] for i in range(first, len(ids), 64)]
        at = 0
        for i, own in enumerate(cuts):
            want.append((doc_id or -1, i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own))
            at += len(own)
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32, list(r.ids)) for r in got) == sorted(want)
    assert packing.pieces(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_and_bounds(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 10, 24])
    lengths = [draw.randint(1, capacity - 1) for _ in range(9)]
    bins, least = packing.Bins(counted(lengths, capacity)), packing.bound(counted(lengths, capacity))
    assert bins.number == plain_best_fit(lengths, capacity)
    assert -(-least // capacity) <= fewest(lengths, capacity) <= bins.number
    many = [draw.choice([draw.randint(1, 99), 34, 50, 51]) for _ in range(700)]
    bins = packing.Bins(counted(many, 100))
    assert bins.number == plain_best_fit(many, 100)
    assert bins.counts(bins.groups, 100).tolist() == counted(many, 100).tolist()
    before = bins.number
    bins.improve(100, 0)
    assert bins.number <= before
    assert bins.counts(bins.groups, 100).tolist() == counted(many, 100).tolist()


def test_bound_of_large_pieces():
    assert packing.bound(counted([6, 6, 6, 5, 5], 10)) == 40
    assert packing.bound(counted([4] * 6, 10)) == 30


def test_packed_rows(spark, monkeypatch):
    """Several levels of groups, equal rows, whole pieces, and columns with the names that the operator uses."""
    monkeypatch.setattr(packing, "MOST", 64)
    monkeypatch.setattr(packing, "LEAST", 16)
    draw = random.Random(5)
    lengths = [draw.choice([draw.randint(1, 100), 30, 71, 100]) for _ in range(900)]
    rows = spark.createDataFrame([(i % 850, n, "x", 1, 2) for i, n in enumerate(lengths)], "doc_id long, length long, row string, uid int, p int")
    got = packing.pack(rows, 100).collect()
    assert sorted((r.doc_id, r.length, r.row, r.uid, r.p) for r in got) == sorted((i % 850, n, "x", 1, 2) for i, n in enumerate(lengths))
    number = check_places(got, 100)
    part = [n for n in lengths if n < 100]
    whole = len(lengths) - len(part)
    # groups that meet their own bound leave, so the rest may need one more than all together
    assert -(-packing.bound(counted(part, 100)) // 100) <= number - whole <= plain_best_fit(part, 100) + 1
    assert packing.pack(spark.createDataFrame([], "length long")).count() == 0
    alone = packing.pack(spark.createDataFrame([(100,), (100,)], "length long"), 100).collect()
    assert check_places(alone, 100) == 2


def test_sequences_give_texts_back(spark, tokenizer):
    rows = hard_documents()
    packed = packing.pack(packing.pieces(frame(spark, rows), PATH, 128, with_ids=True), 128)
    held = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    texts = {}
    for r in sorted(packed.collect(), key=lambda r: r.start):
        ids = held[r.sequence_id][r.offset : r.offset + r.length]
        assert ids == list(r.ids)
        if r.doc_id not in (None, 5):
            texts.setdefault(r.doc_id, []).extend(ids)
    for doc_id, text in rows:
        if doc_id not in (None, 5):
            assert tokenizer.decode(texts[doc_id][:-1], skip_special_tokens=False) == (text or "")
            assert texts[doc_id][-1] == 0
