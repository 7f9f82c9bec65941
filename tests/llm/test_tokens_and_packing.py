"""Token counts and packing against the tokenizer's library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspan.llm.packing import Room, first_fit_decreasing, pack
from quillspan.llm.token_counts import count_tokens
from quillspan.llm.tokens import Words, prove_whole_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = list("abcXYZ '.,!0129éÉßÿÀ×÷ªµ<|>日İΣςﬁ🙂²½\t\n\x0b\x0c\x1c\x85") + ["é", " ", "​", "<|endoftext|>", "'s", "'LL", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library(library, monkeypatch):
    monkeypatch.setattr("quillspan.llm.tokens.MEMORY_WORDS", 60_000)
    json = open(PATH, encoding="utf-8").read()
    words = Words(json, prove_whole_tokens(json), list)
    made = texts(8000) + ["", " ", "x" * 100_000, "the quick " * 30_000, "The QUICK brown-fox's"]
    for text, found in zip(made, words.values(t.encode() for t in made)):
        assert [i for ids in found for i in ids] == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_proven_strings_are_whole_tokens_in_context(library):
    proven = prove_whole_tokens(open(PATH, encoding="utf-8").read())
    assert len(proven) > 20_000
    some = sorted(proven)[::97]
    assert library.encode(" ".join(some), add_special_tokens=False).ids == [proven[s] for s in some]


def test_counts_equal_the_library(spark, library):
    made = [*texts(200, 2), None, "", " \n", "word " * 3000, "y" * 40_000]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x") for i, t in enumerate(made)] * 2, "doc_id long, text string, n_tokens string")
    got = count_tokens(docs, PATH, limit=2048)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == 2 * len(made)
    for row in rows:
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((row.text or "").encode()), n, n > 2048)
    assert count_tokens(docs.limit(0), PATH, limit=2048).count() == 0


def brute_first_fit(lengths, capacity):
    room, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(capacity)
        out[i] = (at, capacity - room[at])
        room[at] -= lengths[i]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tournament_tree_is_first_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 50, 64, rng.randrange(1, 65)]) for _ in range(rng.randrange(1, 300))]
    sequence, offset = first_fit_decreasing(np.array(lengths), 64)
    assert list(zip(sequence.tolist(), offset.tolist())) == brute_first_fit(lengths, 64)


def test_room_of_one():
    room = Room(1, 5)
    assert (room.first_with(5), room.take(0, 5)) == (0, 0)


@pytest.mark.parametrize("rows", [0, 1, 90])
def test_packed_pieces_hold_every_id_once(spark, library, rows):
    made = [*texts(80, 3), None, "", "word " * 3000, "y z " * 9000][-rows:] if rows else []
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, t, 1) for i, t in enumerate(made)], "doc_id long, text string, start int")
    got = pack(docs, PATH, capacity=256, end_id=1, group_docs=20).collect()
    ids = [(i // 2 if i % 7 else None, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in enumerate(made)]
    want = sorted(
        (str(d), s, len(x[s : s + 256]), zlib.crc32(np.array(x[s : s + 256], "<u4").tobytes()), len(x))
        for d, x in ids for s in range(0, len(x), 256)
    )
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256


def test_equal_rows_spread_over_the_groups(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 6000 + [(i, f"text {i}") for i in range(2000)], "doc_id long, text string").repartition(8)
    rows = pack(docs, PATH, 2048, 1, group_docs=200).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["sequence_id"] >> 32] += 1
    assert len(rows) == 8000 and len(sizes) == 40 and max(sizes.values()) < 2 * 200
