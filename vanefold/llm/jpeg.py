"""Baseline JPEG as a lossless store of bytes, and a reader of its headers, scans and DC-only thumbnails, in numpy.

A payload of 64 n bytes becomes n blocks of 64 coefficients, each a byte less 128 (the format's unit: coefficients are
coded without loss, whereas samples pass a rounded transform). There is a restart marker after every block, so that the
reader decodes all blocks of all files of a batch in step. The grid is as square as n allows; blocks that fill its last
row up hold zeros, and a comment segment holds the payload's length.

The reader takes any baseline file: any Huffman and quantization tables, one to four components with subsampling, with
or without restart intervals. Progressive and arithmetic files raise ValueError.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from xxhash import xxh3_64_hexdigest

BLOCK = 64
MAGIC = b"payload:"


def _lengths() -> dict[int, int]:
    """Code lengths of AC symbols (run << 4 | size) that suit text: bytes of letters have sizes 4, 5 and 7."""
    out = {s: 2 if s in (4, 5, 7) else 4 if s in (3, 6) else 6 for s in range(1, 9)}
    out |= {0x00: 8, 0xF0: 8}
    return out | {run << 4 | s: 11 for run in range(1, 16) for s in range(1, 9)}


def _table(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    """(number of codes by length 1 to 16, symbols in the order of their codes)."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(lengths[s] == n for s in symbols) for n in range(1, 17)], symbols


def _codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    out, code, at = [], 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out.append((symbols[at], code, n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


AC = _table(_lengths())
DC = _table({s: 2 if s in (4, 5, 7) else 4 if s in (3, 6) else 6 for s in range(9)})


def _by_symbol(t: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for s, c, n in _codes(*t):
        code[s], length[s] = c, n
    return code, length


_AC_CODE, _AC_LEN = _by_symbol(AC)
_DC_CODE, _DC_LEN = _by_symbol(DC)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, t: tuple[list[int], list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind, *t[0], *t[1]]))


def grid(blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks."""
    cols = min(8191, math.isqrt(blocks - 1) + 1)
    return cols, -(-blocks // cols)


def _header(payload_bytes: int, cols: int, rows: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xFE, MAGIC + str(payload_bytes).encode()),
            _segment(0xDB, bytes([0] + [1] * 64)),
            _segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            _dht(0x00, DC),
            _dht(0x10, AC),
            _segment(0xDD, (1).to_bytes(2, "big")),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _tokens() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits to write, their number) of a first and of another coefficient without a run, by coefficient + 128."""
    v = np.arange(256) - 128
    size = np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
    extra = np.where(v < 0, v + (1 << size) - 1, v)
    return tuple(x.astype(np.uint64) for x in (_DC_CODE[size] << size | extra, _DC_LEN[size] + size, _AC_CODE[size] << size | extra, _AC_LEN[size] + size))


_DC_VALUE, _DC_BITS, _AC_VALUE, _AC_BITS = _tokens()


def _runs(coefs: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
    """Corrects the tokens of blocks in which a coefficient after the first is zero."""
    zero = coefs == 128
    zero[:, 0] = False
    k = np.arange(BLOCK)
    before = np.maximum.accumulate(np.where(zero, -1, k), axis=1)  # the last place without a zero
    tail = np.minimum.accumulate(zero[:, ::-1], axis=1)[:, ::-1]  # zeros up to the end
    run = k - np.concatenate([np.zeros((len(coefs), 1), dtype=before.dtype), before[:, :-1]], axis=1) - 1
    size = np.frexp(np.abs(coefs.astype(np.int64) - 128).astype(np.float64))[1].astype(np.int64)
    symbol = (run & 15) << 4 | size
    follows = ~zero & (run > 0) & (k > 0)
    v = coefs.astype(np.int64) - 128
    extra = np.where(v < 0, v + (1 << size) - 1, v)
    value[follows] = (_AC_CODE[symbol] << size | extra)[follows].astype(np.uint64)
    bits[follows] = (_AC_LEN[symbol] + size)[follows].astype(np.uint64)
    value[zero] = bits[zero] = 0
    sixteenth = zero & ~tail & ((k - before) % 16 == 0)
    value[sixteenth], bits[sixteenth] = _AC_CODE[0xF0], _AC_LEN[0xF0]
    end = tail[:, -1]
    value[end, -1], bits[end, -1] = _AC_CODE[0], _AC_LEN[0]


def _scan_bytes(coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of blocks (n, 64) of coefficients + 128, stuffed, each block padded to a byte and followed by two free bytes; the end of each block."""
    n = len(coefs)
    value, bits = _AC_VALUE[coefs], _AC_BITS[coefs]
    value[:, 0], bits[:, 0] = _DC_VALUE[coefs[:, 0]], _DC_BITS[coefs[:, 0]]
    gaps = np.flatnonzero((coefs[:, 1:] == 128).any(axis=1))
    if len(gaps):
        v, b = value[gaps], bits[gaps]
        _runs(coefs[gaps], v, b)
        value[gaps], bits[gaps] = v, b
    value = value[:, 0::2] << bits[:, 1::2] | value[:, 1::2]
    bits = bits[:, 0::2] + bits[:, 1::2]
    stop = np.cumsum(bits, axis=1, dtype=np.uint64)
    pad = (-stop[:, -1].astype(np.int64)).astype(np.uint64) & np.uint64(7)  # ones to the byte's end
    value[:, -1] = value[:, -1] << pad | (np.uint64(1) << pad) - np.uint64(1)
    bits[:, -1] += pad
    stop[:, -1] += pad
    size_bytes = (stop[:, -1] >> np.uint64(3)).astype(np.int64)
    ends = np.cumsum(size_bytes)
    total = int(ends[-1])
    stop = (stop + ((ends - size_bytes) * 8).astype(np.uint64)[:, None]).reshape(-1)
    value, pos = value.reshape(-1), stop - bits.reshape(-1)
    word, last = (pos >> np.uint64(6)).astype(np.int64), stop & np.uint64(63)
    whole = (stop - np.uint64(1)) >> np.uint64(6) == word.astype(np.uint64)
    out = np.zeros(total // 8 + 2, dtype=np.uint64)
    np.add.at(out, word, np.where(whole, value << ((np.uint64(64) - last) & np.uint64(63)), value >> last))
    over = np.flatnonzero(~whole)
    np.add.at(out, word[over] + 1, value[over] << (np.uint64(64) - last[over]))
    raw = out.byteswap().view(np.uint8)[:total]
    more = (raw == 0xFF).astype(np.int32)
    more[ends - 1] += 2
    done = np.cumsum(more, dtype=np.int64)
    stuffed = np.zeros(total + int(done[-1]), dtype=np.uint8)
    stuffed[np.arange(total) + (done - more)] = raw
    return stuffed, ends + done[ends - 1] - 2


def write_files(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload; its length has to be a positive multiple of 64."""
    shapes, parts = [], []
    for p in payloads:
        if not p or len(p) % BLOCK:
            raise ValueError("a payload is a positive multiple of 64 bytes")
        cols, rows = grid(len(p) // BLOCK)
        shapes.append((cols, rows))
        parts.append(p + b"\x80" * (cols * rows * BLOCK - len(p)))
    coefs = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, BLOCK)
    data, ends = _scan_bytes(coefs)
    blocks = np.array([c * r for c, r in shapes])
    stop = np.cumsum(blocks)
    within = np.arange(len(ends)) - np.repeat(stop - blocks, blocks)
    data[ends] = 0xFF
    data[ends + 1] = 0xD0 + within % 8
    data[ends[stop - 1] + 1] = 0xD9
    cuts = np.concatenate([[0], ends[stop - 1] + 2])
    return [_header(len(p), c, r) + data[a:b].tobytes() for p, (c, r), a, b in zip(payloads, shapes, cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Head:
    """What the markers before a scan say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantization table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple] = field(default_factory=dict)
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    comments: list[bytes] = field(default_factory=list)
    at: int = 0


def parse(data: bytes) -> Head:
    """The segments up to the first scan's data."""
    head, i = Head(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        while data[i : i + 2] == b"\xff\xff":
            i += 1
        if i + 4 > len(data) or data[i] != 0xFF:
            raise ValueError("a broken marker")
        m, n = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
        body = data[i + 4 : i + 2 + n]
        i += 2 + n
        if m == 0xDB:
            while body:
                wide = body[0] >> 4
                step = 128 if wide else 64
                head.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + step], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + step :]
        elif m == 0xC0:
            head.height, head.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            head.components = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5])]
        elif m in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline file")
        elif m == 0xC4:
            while body:
                counts = tuple(body[1:17])
                head.huffman[body[0]] = (counts, tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif m == 0xDD:
            head.restart = int.from_bytes(body[:2], "big")
        elif m == 0xFE:
            head.comments.append(body)
        elif m == 0xDA:
            ids = [c[0] for c in head.components]
            head.scan = [(ids.index(body[1 + 2 * c]), body[2 + 2 * c] >> 4, 16 | body[2 + 2 * c] & 15) for c in range(body[0])]
            head.at = i
            return head


_luts: dict[tuple, np.ndarray] = {}


def _lut(t: tuple) -> np.ndarray:
    """length << 8 | symbol by the next 16 bits; 0 where no code fits."""
    if t not in _luts:
        out = np.zeros(1 << 16, dtype=np.int32)
        for s, c, n in _codes(list(t[0]), list(t[1])):
            out[c << (16 - n) : (c + 1) << (16 - n)] = n << 8 | s
        if len(_luts) > 64:
            _luts.clear()
        _luts[t] = out
    return _luts[t]


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, start of each restart interval) of scans joined together."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    keep = np.ones(len(scan), dtype=bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after >= 0xD0]
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    return scan[keep], np.concatenate([[0], place[marks]])


def _units(head: Head) -> list[tuple[int, int, int]]:
    """(component, DC table, AC table) of each block of one MCU."""
    if len(head.scan) == 1:
        return list(head.scan)
    return [s for s in head.scan for _ in range(head.components[s[0]][1] * head.components[s[0]][2])]


def _step_decode(data: np.ndarray, starts: np.ndarray, mcus: np.ndarray, units: list[tuple[int, int, int]], huffman: dict) -> np.ndarray:
    """Coefficients (interval, MCU, unit, 64) in scan order; all intervals advance together, a symbol at a time."""
    lanes, most = len(starts), int(mcus.max())
    d = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    window = d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]
    end = len(window) - 1
    pos = starts.astype(np.int64) * 8
    out = np.zeros((lanes, most, len(units), BLOCK), dtype=np.int16)
    flat = out.reshape(-1)
    guess = np.zeros((lanes, max(u[0] for u in units) + 1), dtype=np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        return (window[np.minimum(p >> 3, end)] << (p & 7).astype(np.uint32)) >> np.uint32(16)

    def number(p: np.ndarray, s: np.ndarray) -> np.ndarray:
        v = (peek(p) >> (16 - s).astype(np.uint32)).astype(np.int64)
        return np.where((s > 0) & (v < (1 << np.maximum(s, 1)) >> 1), v - (1 << s) + 1, v)

    for m in range(most):
        live = np.flatnonzero(mcus > m)
        for u, (c, dc, ac) in enumerate(units):
            lut_dc, lut_ac = _lut(huffman[dc]), _lut(huffman[ac])
            p = pos[live]
            e = lut_dc[peek(p)]
            s = (e & 255).astype(np.int64)
            p = p + (e >> 8)
            guess[live, c] += number(p, s)
            p = p + s
            base = ((live * most + m) * len(units) + u) * BLOCK
            flat[base] = guess[live, c]
            k = np.ones(len(live), dtype=np.int64)
            act = np.arange(len(live))
            while len(act):
                q = p[act]
                e = lut_ac[peek(q)]
                if not e.all():
                    raise ValueError("a broken scan")
                symbol = (e & 255).astype(np.int64)
                q = q + (e >> 8)
                s = symbol & 15
                kk = k[act] + (symbol >> 4)
                put = s > 0
                if put.all():
                    flat[base[act] + kk] = number(q, s)
                else:
                    flat[base[act[put]] + kk[put]] = number(q[put], s[put])
                    kk = np.where(symbol == 0, BLOCK, kk)  # end of block; 0xF0 skips 16
                p[act] = q + s
                k[act] = kk + 1
                act = act[kk + 1 < BLOCK]
            pos[live] = p
    return out


def read_files(files: list[bytes]) -> list[tuple[Head, np.ndarray]]:
    """(head, coefficients (MCU, unit, 64) in scan order) of each file; files with equal tables are decoded together."""
    heads = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault((tuple(sorted(h.huffman.items())), tuple(_units(h)), h.restart), []).append(i)
    out: list = [None] * len(files)
    for who in groups.values():
        cuts, starts, counts, joined, offset = [], [], [], [], 0
        for i in who:
            h = heads[i]
            end = files[i].rfind(b"\xff\xd9")
            joined.append(np.frombuffer(files[i], dtype=np.uint8, count=(end if end >= h.at else len(files[i])) - h.at, offset=h.at))
        # a restart marker parts the files, so that all scans are cut in one go
        mark = np.array([0xFF, 0xD0], dtype=np.uint8)
        data, begins = _intervals(np.concatenate([x for j in joined for x in (j, mark)][:-1] + [np.zeros(1, dtype=np.uint8)]))
        for i in who:
            h = heads[i]
            hs, vs = max(c[1] for c in h.components), max(c[2] for c in h.components)
            if len(h.scan) == 1:
                hs = vs = 1
            total = -(-h.width // (8 * hs)) * -(-h.height // (8 * vs))
            step = h.restart or total
            n = -(-total // step)
            counts.append(np.minimum(step, total - step * np.arange(n)))
            starts.append(begins[offset : offset + n])
            cuts.append(n)
            offset += n
            scan = joined[len(cuts) - 1]
            if int(np.count_nonzero((scan[:-1] == 0xFF) & (scan[1:] & 0xF8 == 0xD0))) != n - 1:
                raise ValueError("a broken scan")
        got = _step_decode(data, np.concatenate(starts), np.concatenate(counts), _units(heads[who[0]]), heads[who[0]].huffman)
        at = 0
        for i, n, c in zip(who, cuts, counts, strict=True):
            part = got[at : at + n]
            flat = part.reshape(-1, *part.shape[2:])
            out[i] = (heads[i], flat[: int(c.sum())] if n == 1 or c[-1] == part.shape[1] else np.concatenate([x[:y] for x, y in zip(part, c, strict=True)]))
            at += n
    return out


def thumbnail(head: Head, coefs: np.ndarray) -> np.ndarray:
    """Luminance from DC terms alone, one value a block: (rows, cols) of bytes."""
    units = _units(head)
    ids = [i for i, u in enumerate(units) if u[0] == head.scan[0][0]]
    comp = head.components[head.scan[0][0]]
    h, v = (1, 1) if len(head.scan) == 1 else (comp[1], comp[2])
    step = int(head.quant[comp[3]][0])
    dc = coefs[:, ids, 0].astype(np.int64) * step
    level = np.clip(np.floor_divide(dc, 8) + 128, 0, 255).astype(np.uint8)
    hs, vs = (1, 1) if len(head.scan) == 1 else (max(c[1] for c in head.components), max(c[2] for c in head.components))
    across = -(-head.width // (8 * hs))
    down = -(-head.height // (8 * vs))
    return level.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits: whether the brightness of an 8 x 9 reduction falls from left to right."""
    r = (np.arange(8) * thumb.shape[0]) // 8
    c = (np.arange(9) * thumb.shape[1]) // 9
    small = thumb[np.ix_(r, c)].astype(np.int16)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def feature(head: Head, coefs: np.ndarray) -> str:
    """Dimensions, difference hash and digest of the thumbnail."""
    t = thumbnail(head, coefs)
    return f"{head.width}x{head.height}:{difference_hash(t)}:{xxh3_64_hexdigest(t.tobytes())}"


def payload(head: Head, coefs: np.ndarray) -> bytes:
    """The bytes that write_files stored."""
    n = next(int(c[len(MAGIC) :]) for c in head.comments if c.startswith(MAGIC))
    return (coefs.reshape(-1)[:n] + 128).astype(np.uint8).tobytes()
