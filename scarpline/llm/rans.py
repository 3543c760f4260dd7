"""Range asymmetric numeral systems with static tables, over numpy arrays.

A block of symbols is coded by LANES interleaved states of 64 bits that share one stream of 32-bit words: symbol i belongs
to lane ``i mod LANES``. Coding runs backwards, so decoding runs forwards. Every CHECK steps the states and the place in
the stream are kept as a checkpoint; the parts between checkpoints decode independently of each other, and so do blocks.
All blocks of a call are coded, and all parts decoded, at the same time, one numpy operation for all of them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Frequencies sum to 2 ** BITS.
BITS = 18
LANES = 32
CHECK = 256
#: Symbols in a full block.
BLOCK = 32 * 1024
_LOW = np.uint64(1) << np.uint64(31)
_32, _B = np.uint64(32), np.uint64(BITS)
_HEAD = struct.Struct("<4sIIIII")  # magic, symbols, parts, words, crc32 of the symbols, crc32 of the rest


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2 ** BITS in proportion to the counts, 1 at least for each symbol that occurs."""
    total, one = int(counts.sum()), 1 << BITS
    if (counts > 0).sum() > one:
        raise ValueError("more symbols than the tables have room for")
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (one / total))), 0).astype(np.int64)
    while over := int(freq.sum()) - one:
        # The largest give or take what rounding left over, in proportion.
        order = np.argsort(-freq, kind="stable")[: max(1, min(abs(over), int((freq > 1).sum())))]
        step = np.maximum(1, np.floor(freq[order] * (abs(over) / max(1, int(freq[order].sum()))))).astype(np.int64)
        step = np.minimum(step, np.maximum(0, abs(over) - np.concatenate(([0], np.cumsum(step)[:-1]))))
        freq[order] += -np.minimum(step, freq[order] - 1) if over > 0 else step
    return freq.astype(np.uint32)


class Tables:
    """What coder and decoder share."""

    def __init__(self, freq: np.ndarray) -> None:
        # One more symbol of the full range stands for the places behind a block's end; coding it changes nothing.
        self.none = len(freq)
        self.freq = np.append(freq.astype(np.uint64), np.uint64(1 << BITS))
        self.start = np.append(np.concatenate(([0], np.cumsum(freq.astype(np.uint64))[:-1])) if len(freq) else np.zeros(0), 0).astype(np.uint64)
        # Small tables stay in the processor's cache.
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) < 1 << 16 else np.uint32), freq.astype(np.int64))


def encode(symbols: np.ndarray, t: Tables) -> list[bytes]:
    """Blocks of BLOCK symbols, the last one shorter."""
    out: list[bytes] = []
    width = 64 * BLOCK
    for at in range(0, len(symbols), width):
        out += _encode(symbols[at : at + width], t)
    return out


def _encode(symbols: np.ndarray, t: Tables) -> list[bytes]:
    n = len(symbols)
    blocks, steps = -(-n // BLOCK), min(BLOCK, -(-n // LANES) * LANES) // LANES
    padded = np.full(blocks * steps * LANES, t.none, np.uint32)
    padded[:n] = symbols
    grid = padded.reshape(blocks, steps, LANES)
    parts = -(-steps // CHECK)
    state = np.full((blocks, LANES), _LOW, np.uint64)
    checks = np.zeros((parts, blocks, LANES), np.uint64)
    counts = np.zeros((steps, blocks), np.int32)
    emitted: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    shift = np.uint64(63 - BITS)
    for s in range(steps - 1, -1, -1):
        sym = grid[:, s, :]
        f = t.freq[sym]
        full = state >= (f << shift)
        counts[s] = full.sum(1)
        emitted.append((state[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(np.nonzero(full)[0].astype(np.int16))
        state = np.where(full, state >> _32, state)
        q = state // f
        state = (q << _B) + (state - q * f) + t.start[sym]
        if s % CHECK == 0:
            checks[s // CHECK] = state
    words, owner = np.concatenate(emitted[::-1]), np.concatenate(owners[::-1])
    words = words[np.argsort(owner, kind="stable")]  # by block, then by step and lane
    ends = np.cumsum(counts.sum(0))
    before = np.concatenate((np.zeros((1, blocks), np.int64), np.cumsum(counts, 0, dtype=np.int64)))
    out = []
    for b in range(blocks):
        size = min(BLOCK, n - b * BLOCK)
        k = -(-size // (CHECK * LANES))
        mine = words[ends[b] - counts[:, b].sum() : ends[b]]
        body = before[[i * CHECK for i in range(k)], b].astype("<u4").tobytes() + checks[:k, b].astype("<u8").tobytes() + mine.astype("<u4").tobytes()
        crc = zlib.crc32(symbols[b * BLOCK : b * BLOCK + size].astype("<u4").tobytes())
        out.append(_HEAD.pack(b"RANS", size, k, len(mine), crc, zlib.crc32(body)) + body)
    return out


def decode(blocks: list[bytes], t: Tables) -> list[np.ndarray]:
    """The symbols of each block, as 32-bit numbers; raises where a checksum is wrong."""
    out: list[np.ndarray] = []
    for at in range(0, len(blocks), 64):
        out += _decode(blocks[at : at + 64], t)
    return out


def part(block: bytes, k: int, t: Tables) -> np.ndarray:
    """The symbols from checkpoint k to the next, without decoding what is before them."""
    size, _, words, first, state, _ = _unpack(block)
    return _run(words, np.zeros(1, np.int64) + first[k], state[k : k + 1], np.array([min(CHECK * LANES, size - k * CHECK * LANES)]), t)[0]


def _unpack(block: bytes) -> tuple:
    magic, size, k, n, crc, body = _HEAD.unpack_from(block)
    at = _HEAD.size
    if magic != b"RANS" or len(block) != at + 4 * k + 8 * k * LANES + 4 * n or zlib.crc32(memoryview(block)[at:]) != body:
        raise ValueError("a damaged block")
    first = np.frombuffer(block, "<u4", k, at).astype(np.int64)
    state = np.frombuffer(block, "<u8", k * LANES, at + 4 * k).reshape(k, LANES)
    return size, k, np.frombuffer(block, "<u4", n, at + 4 * k + 8 * k * LANES), first, state, crc


def _run(words: np.ndarray, at: np.ndarray, state: np.ndarray, size: np.ndarray, t: Tables) -> list[np.ndarray]:
    """Decode parts: at, where each reads its first word; size, the symbols of each."""
    steps = -(-int(size.max()) // LANES)
    words = np.append(words, np.zeros(LANES, np.uint32)).astype(np.uint64)  # places beyond the end are looked at, not used
    grid = np.zeros((len(at), steps, LANES), np.uint32)
    mask, at, state = np.uint64((1 << BITS) - 1), at.copy(), state.astype(np.uint64)
    lanes = np.arange(LANES)
    whole = int(size.min()) // LANES
    for s in range(steps):
        slot = state & mask
        sym = t.symbol[slot]
        if s >= whole:
            sym = np.where(s * LANES + lanes < size[:, None], sym, t.none)
        grid[:, s] = sym
        state = t.freq[sym] * (state >> _B) + slot - t.start[sym]
        low = state < _LOW
        taken = np.cumsum(low, 1)
        place = np.minimum(at[:, None] + taken - 1, len(words) - 1)
        state = np.where(low, (state << _32) | words[place], state)
        at += taken[:, -1]
    flat = grid.reshape(len(at), -1)
    return [flat[i, :n] for i, n in enumerate(size)]


def _decode(blocks: list[bytes], t: Tables) -> list[np.ndarray]:
    found = [_unpack(b) for b in blocks]
    words = np.concatenate([f[2] for f in found])
    base = np.concatenate(([0], np.cumsum([len(f[2]) for f in found])[:-1]))
    at = np.concatenate([f[3] + o for f, o in zip(found, base, strict=True)])
    sizes = np.concatenate([np.minimum(CHECK * LANES, f[0] - np.arange(f[1]) * CHECK * LANES) for f in found])
    parts = _run(words, at, np.concatenate([f[4] for f in found]), sizes, t)
    out, i = [], 0
    for f in found:
        whole = np.concatenate(parts[i : i + f[1]])
        i += f[1]
        if zlib.crc32(whole.astype("<u4").tobytes()) != f[5]:
            raise ValueError("a block does not match its checksum")
        out.append(whole)
    return out
