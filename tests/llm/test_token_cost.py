import tracemalloc
import zlib

import numpy as np
import pytest

from palimpsest.llm import bpe, token_file


def peak_mb(f, *args):
    tracemalloc.start()
    try:
        return f(*args), tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_a_frame_is_packed_in_little_memory():
    ids = (np.random.default_rng(1).zipf(1.3, token_file.FRAME_IDS) % 50_000).astype(np.uint32)
    data, mb = peak_mb(token_file.pack, ids)
    assert mb < 80
    assert (token_file.unpack(data) == ids).all()


def test_merges_are_not_loaded_for_ordinary_texts(monkeypatch):
    monkeypatch.setattr(bpe, "_loaded", {})
    monkeypatch.setattr(token_file, "_library", {})
    encoder = token_file.library_encoder(bpe.read_spec())
    assert [len(ids) > 0 for _, ids, ended in encoder.texts(["one two", "é" * 70]) if ended] == [True, True]
    assert not bpe._loaded
    endless = list(encoder.texts(["a" * (bpe.BLOCK_CHARS + 5)]))  # longer than a block: needs the merges
    assert bpe._loaded and endless[-1][2]


def test_predictions_are_foreseen_as_a_table_makes_them():
    ids = np.random.default_rng(2).choice(np.array([0, 0, 1, 7, 40_000], np.uint16), (3, 200))
    got = token_file.foreseen(ids)
    for lane, row in enumerate(ids.tolist()):
        tables, last, before = ({}, {}), 0, 0
        for step, x in enumerate(row):
            places = token_file.contexts(np.array([[last]], np.int32), np.array([[before]], np.int32))[0].tolist()
            for table, place, seen in zip(tables, places, got, strict=True):
                found, trust = table.get(place, (0, 0))
                assert seen[step, lane] == 2 * trust + (found == x)
                table[place] = (x, min(trust + 1, 3) if found == x else 0)
            last, before = x, last


def test_damage_inside_a_block_is_noticed():
    ids = np.random.default_rng(3).integers(0, 5000, 3 * token_file.BLOCK_IDS).astype(np.uint32)
    data = token_file.pack(ids)
    for at in range(40, len(data), len(data) // 9):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(token_file.DamagedFile):
            token_file.unpack(bytes(bad))


def test_ids_of_all_spreads_come_back():
    rng = np.random.default_rng(4)
    for size in (1, 3, 256, 65_536):
        ids = rng.integers(0, size, 64 * token_file.BLOCK_IDS + 1).astype(np.uint32)
        back = token_file.unpack(token_file.pack(ids))
        assert zlib.crc32(back.tobytes()) == zlib.crc32(ids.tobytes())
