import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from profilescope.llm.encoding import PartEncoder, encoder
from profilescope.llm.packing import Piece, SquaresPacker, op10, pack
from tokenizers import Tokenizer

FILE = str(public_tokenizers.path("word_bpe_49k.json"))
TOKENIZER = Tokenizer.from_file(FILE)
PARTS = PartEncoder(FILE, limit=50)


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60))
def test_parts_encode_as_the_whole_text(text):
    text = text.encode("utf-8", "replace").decode()
    want = TOKENIZER.encode(text, add_special_tokens=False).ids if text else []
    assert list(struct.unpack(f"<{len(want)}I", PARTS.encode(text))) == want


def test_an_encoder_caches_no_more_than_it_is_told():
    text = " ".join(f"part{i}." for i in range(500))
    few, many = encoder(limit=40), encoder()
    assert few.encode(text) == many.encode(text) and len(few) <= 40 and len(few.pieces) <= 40 and len(many) >= 500


def test_the_size_of_the_cache_changes_no_piece(odd):
    few, many = (sorted(map(str, pack(odd, capacity=64, cached_parts=n).collect())) for n in (3, 1000))
    assert few == many


@settings(deadline=None)
@given(st.lists(st.integers(1, 15), max_size=60))
def test_levels_keep_the_sum_of_squares_smallest(sizes):
    packer = SquaresPacker(16, max_open=10**6)
    for size in sizes:
        counts = Counter({h: int(n) for h, n in enumerate(packer.levels) if n})
        level = packer.level_for(size)

        def squares(h, size=size, counts=counts):
            after = Counter(counts)
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] += 1
            return sum(n * n for n in after.values())

        possible = [0, *(h for h in counts if h + size <= 16)]
        assert level in possible
        assert squares(level) == min(map(squares, possible))
        list(packer.add(Piece(1, 0, bytes(4 * size), size)))


@settings(deadline=None)
@given(st.lists(st.integers(1, 15), max_size=80), st.integers(1, 4))
def test_every_token_lies_in_one_sequence(sizes, most):
    packer, windows = SquaresPacker(16, max_open=most), []
    for i, size in enumerate(sizes):
        windows += packer.add(Piece(i, 0, bytes([i]) * 4 * size, size))
    windows += packer.finish()
    lengths = [sum(map(len, w)) for w in windows]
    assert all(n == 16 or n & (n - 1) == 0 for n in lengths)
    assert sum(lengths) == sum(sizes)
    seen = defaultdict(list)
    for piece in (p for w in windows for p in w):
        seen[piece.doc_id].append((piece.start, len(piece)))
    for i, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == size


def test_pieces_rebuild_documents(odd, odd_rows):
    pieces = pack(odd, capacity=64).collect()
    want = Counter()
    for doc_id, text, *_ in odd_rows:
        ids = (TOKENIZER.encode(text, add_special_tokens=False).ids if text else []) + [2]
        want[doc_id] += len(ids)
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += len(p["ids"]) // 4
    assert got == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], len(p["ids"]) // 4))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0


def test_contract_digests(odd, none):
    rows = op10(odd).collect()
    text = [r for r in rows if r["doc_id"] == 9]
    assert [r["doc_tokens"] for r in text] == [2]
    ids = TOKENIZER.encode("x", add_special_tokens=False).ids + [2]
    assert text[0]["ids_crc32"] == zlib.crc32(struct.pack("<2I", *ids))
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {1}
    assert op10(none).count() == 0
