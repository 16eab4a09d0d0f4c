import hashlib
import random
import zlib

import numpy as np
import pytest

from lorespark.llm import webp

RNG = np.random.default_rng(7)


def write_image(w, argb, main, cache_bits=0, tokens=None, groups=None, meta=None, meta_bits=0):
    """An entropy-coded image from tokens: ("lit", argb), ("ref", length, distance code), ("cache", index)."""
    height, width = argb.shape
    tokens = tokens if tokens is not None else [("lit", int(v)) for v in argb.ravel()]
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(meta is not None), 1)
        if meta is not None:
            w.put(meta_bits - 2, 3)
            write_image(w, meta.astype(np.uint32) << 8, False)
    n_groups = 1 if meta is None else int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(n_groups)]
    out, at = [], 0

    def prefix(v):
        if v <= 4:
            return v - 1, 0, 0
        k = (v - 1).bit_length() - 1
        half = (v - 1 >> (k - 1)) & 1
        return 2 * k + half, k - 1, (v - 1) - ((2 + half) << (k - 1))

    for t in tokens:
        g = 0 if meta is None else int(meta[at // width >> meta_bits, at % width >> meta_bits])
        if t[0] == "lit":
            a, r, gr, b = (t[1] >> s & 255 for s in (24, 16, 8, 0))
            syms, at = [(g, 0, gr), (g, 1, r), (g, 2, b), (g, 3, a)], at + 1
            out.append((syms, []))
        elif t[0] == "cache":
            out.append(([(g, 0, 280 + t[1])], []))
            at += 1
        else:
            ls, ln, lx = prefix(t[1])
            ds, dn, dx = prefix(t[2])
            out.append(([(g, 0, 256 + ls), ("x", lx, ln), (g, 4, ds), ("x", dx, dn)], []))
            at += t[1]
    for syms, _ in out:
        for s in syms:
            if s[0] != "x":
                counts[s[0]][s[1]][s[2]] += 1
    codes = []
    for group in counts:
        row = []
        for c in group:
            if not c.any():
                c[0] = 1
            lengths = webp.code_lengths(c) if np.count_nonzero(c) > 1 else c
            if np.count_nonzero(c) == 1 and int(np.flatnonzero(c)[0]) > 255:
                c[0] += 1
                lengths = webp.code_lengths(c)
            w.code(lengths)
            row.append((np.zeros(len(c), int), np.zeros(len(c), int)) if np.count_nonzero(lengths) == 1 else (lengths, webp._canonical(lengths)))
        codes.append(row)
    for syms, _ in out:
        for s in syms:
            if s[0] == "x":
                w.put(s[1], s[2])
            else:
                lengths, code = codes[s[0]][s[1]]
                w.put(int(code[s[2]]), int(lengths[s[2]]))


def file_of(width, height, body):
    w = webp.Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    body(w)
    return webp.container(w.value.to_bytes(-(-w.n // 8), "little"))


def image(height=9, width=13, colours=40):
    palette = RNG.integers(0, 2**32, colours, dtype=np.uint32)
    return palette[RNG.integers(0, colours, (height, width))]


def decoded(data):
    return webp.decode_files([data])[0]


def test_literals_meta_codes_and_cache():
    argb = image()
    meta = RNG.integers(0, 3, (3, 4))
    meta[0, 0] = 2

    def body(w):
        w.put(0, 1)
        write_image(w, argb, True, meta=meta, meta_bits=2)

    assert (decoded(file_of(13, 9, body)) == argb).all()
    seen, tokens, bits = {}, [], 5
    for v in argb.ravel().tolist():
        k = (v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - bits)
        tokens.append(("cache", k) if seen.get(k) == v else ("lit", v))
        seen[k] = v
    assert any(t[0] == "cache" for t in tokens)

    def cached(w):
        w.put(0, 1)
        write_image(w, argb, True, cache_bits=bits, tokens=tokens)

    assert (decoded(file_of(13, 9, cached)) == argb).all()


def test_back_references_near_and_far():
    width = 16
    row = image(1, width).ravel().tolist()
    argb = np.array([row, row, row[3:] + row[:3], [row[0]] * width], np.uint32)
    tokens = [("lit", v) for v in row] + [("ref", 16, 1)]  # distance code 1: one row up
    tokens += [("lit", v) for v in argb[2].tolist()]
    tokens += [("lit", row[0]), ("ref", 15, 2)]  # distance code 2: one to the left, overlapping

    def body(w):
        w.put(0, 1)
        write_image(w, argb, True, tokens=tokens)

    assert (decoded(file_of(width, 4, body)) == argb).all()
    far = np.concatenate([np.arange(300, dtype=np.uint32)] * 2).reshape(30, 20)

    def long(w):
        w.put(0, 1)
        write_image(w, far, True, tokens=[("lit", int(v)) for v in range(300)] + [("ref", 300, 300 + 120)])

    assert (decoded(file_of(20, 30, long)) == far).all()


def predicted(px, y, x, mode, width):
    """Plain integers, from the published description."""
    if y == 0 and x == 0:
        return (255, 0, 0, 0)
    left, top = px[y][x - 1] if x else None, px[y - 1][x] if y else None
    if y == 0:
        return left
    if x == 0:
        return top
    tl, tr = px[y - 1][x - 1], px[y - 1][x + 1] if x + 1 < width else px[y][0]
    avg = lambda a, b: tuple((i + j) // 2 for i, j in zip(a, b, strict=True))
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [left[i] + top[i] - tl[i] for i in range(4)]
        near_left = sum(abs(p[i] - left[i]) for i in range(4)) < sum(abs(p[i] - top[i]) for i in range(4))
        return left if near_left else top
    if mode == 12:
        return tuple(clamp(left[i] + top[i] - tl[i]) for i in range(4))
    if mode == 13:
        m = avg(left, top)
        return tuple(clamp(m[i] + int((m[i] - tl[i]) / 2)) for i in range(4))
    return [(255, 0, 0, 0), left, top, tr, tl, avg(avg(left, tr), top), avg(left, tl), avg(left, top), avg(tl, top), avg(top, tr), avg(avg(left, tl), avg(top, tr))][mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    argb = image(8, 11, 60)
    px = [[tuple(v >> s & 255 for s in (24, 16, 8, 0)) for v in row] for row in argb.tolist()]
    residual = np.zeros_like(argb)
    for y in range(8):
        for x in range(11):
            d = [(a - b) & 255 for a, b in zip(px[y][x], predicted(px, y, x, mode, 11), strict=True)]
            residual[y, x] = d[0] << 24 | d[1] << 16 | d[2] << 8 | d[3]

    def body(w):
        w.put(1, 1)
        w.put(0, 2)
        w.put(0, 3)
        write_image(w, np.full((2, 3), mode << 8, np.uint32), False)
        w.put(0, 1)
        write_image(w, residual, True)

    assert (decoded(file_of(11, 8, body)) == argb).all()


def test_cross_colour_and_green():
    argb = image(6, 6)
    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
    factors = [(3, 200, 17), (250, 9, 128), (0, 1, 2), (90, 91, 92)]  # red to blue, green to blue, green to red
    coded = np.zeros_like(argb)
    blocks = np.array([[0xFF000000 | r << 16 | g << 8 | b for r, g, b in factors[k:k + 2]] for k in (0, 2)], np.uint32)
    for y in range(6):
        for x in range(6):
            rb, gb, gr = (signed(v) for v in factors[y // 4 * 2 + x // 4])
            a, r, g, b = (int(argb[y, x]) >> s & 255 for s in (24, 16, 8, 0))
            nb = b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)
            nr = r - (gr * signed(g) >> 5)
            coded[y, x] = a << 24 | (nr & 255) << 16 | g << 8 | nb & 255
    green = np.array([[a << 24 | (r - g & 255) << 16 | g << 8 | b - g & 255 for a, r, g, b in ([v >> s & 255 for s in (24, 16, 8, 0)] for v in row)] for row in coded.tolist()], np.uint32)

    def body(w):
        w.put(1, 1)
        w.put(1, 2)
        w.put(0, 3)
        write_image(w, blocks, False)
        w.put(1, 1)
        w.put(2, 2)
        w.put(0, 1)
        write_image(w, green, True)

    assert (decoded(file_of(6, 6, body)) == argb).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 11, 16, 17, 200])
def test_palette(colours):
    palette = RNG.integers(0, 2**32, colours, dtype=np.uint32)
    index = RNG.integers(0, colours, (5, 19))
    channels = [[int(v) >> s & 255 for s in (24, 16, 8, 0)] for v in palette]
    deltas = [channels[0]] + [[(b - a) & 255 for a, b in zip(p, q, strict=True)] for p, q in zip(channels, channels[1:], strict=False)]
    packing = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, size = 1 << packing, 8 >> packing
    packed = np.zeros((5, -(-19 // per)), np.uint32)
    for x in range(19):
        packed[:, x // per] |= (index[:, x] << (x % per * size)).astype(np.uint32)

    def body(w):
        w.put(1, 1)
        w.put(3, 2)
        w.put(colours - 1, 8)
        write_image(w, np.array([[a << 24 | r << 16 | g << 8 | b for a, r, g, b in deltas]], np.uint32), False)
        w.put(0, 1)
        write_image(w, packed << np.uint32(8), True)

    assert (decoded(file_of(19, 5, body)) == palette[index]).all()


def test_broken_files_are_refused():
    argb = image(4, 4)

    def body(w):
        w.put(0, 1)
        write_image(w, argb, True)

    good = file_of(4, 4, body)
    for bad in (b"RIFX" + good[4:], good[:12] + b"VP8 " + good[16:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(ValueError):
            decoded(bad)


def test_texts_round_trip(awkward, nothing):
    texts = {}
    for r in awkward.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    rows = webp.media_features(webp.stored_media(awkward)).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        ok = False
        for raw in texts[r["doc_id"]]:
            payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
            ok |= r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert ok
    assert webp.media_features(webp.stored_media(nothing)).count() == 0


def test_equal_texts_are_stored_equally(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc \n") for _ in range(rng.randrange(500))) for _ in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(100)], "doc_id long, text string").repartition(7)
    held = {}
    for r in webp.stored_media(docs).collect():
        held.setdefault(r["doc_id"] % 20, set()).add(bytes(r["media"]))
    assert all(len(v) == 1 for v in held.values())


def stored(*payloads):
    """The files of payloads, and whether their samples are what they decode to."""
    ends = np.cumsum([0] + [len(p) for p in payloads]).astype(np.int64)
    made = [webp.split_files(v) for v in webp.encode_payloads(np.frombuffer(b"".join(payloads), np.uint8), ends)]
    for own, p in zip(made, payloads, strict=True):
        assert b"".join((x >> np.uint32(8)).astype(np.uint8).tobytes() for x in webp.decode_files(own)) == p
    return made


def test_the_encoder_chooses_references_palette_and_prediction():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, 9, dtype=np.uint8)) for _ in range(100)]
    prose = b" ".join(words[i] for i in rng.integers(0, 100, 500))[:4800]
    letters = rng.choice(np.frombuffer(b".x", np.uint8), 192 * 20, p=[0.9, 0.1]).tobytes()
    slope = (np.add.outer(np.arange(32) * 3, rng.integers(0, 256, 192)) % 256).astype(np.uint8).tobytes()
    noise = rng.integers(0, 256, 192 * 7, dtype=np.uint8).tobytes()
    (a,), (b,), (c,), (d,) = stored(prose, letters, slope, noise)
    kinds = [[t[0] for t in webp.File(f).transforms] for f in (a, b, c, d)]
    assert kinds == [[], [3], [0], []]
    assert not webp.File(a).image.plain and webp.File(d).image.plain
    literal = -(np.bincount(np.frombuffer(prose, np.uint8)) / 4800)
    assert len(a) * 8 < 0.7 * 4800 * (literal[literal < 0] * np.log2(-literal[literal < 0])).sum()
    assert len(b) < 192 * 20 / 8 and len(c) < 1200 and len(d) < 192 * 7 + 400


def test_awkward_payloads_come_back():
    rng = np.random.default_rng(4)
    some = [b" " * 192, b"a" * 192 * 32 * 2, bytes(range(192)), (bytes(range(256)) * 60)[:192 * 70], b"ab" * 96 * 33]
    some += [bytes(rng.integers(0, k, 192 * int(rng.integers(1, 80)), dtype=np.uint8) + 250 % k) for k in (1, 2, 3, 4, 5, 16, 17, 200) for _ in range(3)]
    some += [(w := bytes(rng.integers(0, 30, 192 * 40, dtype=np.uint8))) + w[:192 * 9] + w]
    alone = [stored(p)[0] for p in some]
    assert stored(*some) == alone  # no image depends on its neighbours
    assert len(alone[1]) == 2 and len(alone[1][0]) < 60


def test_copies_are_read_as_by_the_general_decoder(monkeypatch):
    rng = np.random.default_rng(5)
    text = b"".join(rng.choice([b"the ", b"quick ", b"brown fox, ", b"jumped ", b"over and over "], 900))
    files = [f for own in stored(*[text[k:k + 192 * 14] for k in range(0, 192 * 7, 192)]) for f in own]
    seen = []
    fast = webp._copied_in_step
    monkeypatch.setattr(webp, "_copied_in_step", lambda images: seen.extend(images) or fast(images))
    first = webp.decode_files(files)
    assert len(seen) == len(files)
    monkeypatch.setattr(webp, "_copied_in_step", webp._general_in_step)
    assert all((a == b).all() for a, b in zip(first, webp.decode_files(files), strict=True))
    with pytest.raises(ValueError):
        monkeypatch.setattr(webp, "_copied_in_step", fast)
        webp.decode_files([webp.container(files[0][20:90])])


def test_the_encoder_chooses_a_colour_cache_and_a_cached_copy_is_read():
    rng = np.random.default_rng(6)
    place = lambda argb: (argb * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - webp.CACHE_BITS)
    places = [[place(alpha << 24 | g << 8) for g in range(256)] for alpha in (255, 0)]
    of = [rng.permutation([g for g in range(256) if places[0][g] == p]) for p in range(1 << webp.CACHE_BITS)]
    stretches = [rng.choice([own[k] for own in of], 384) for k in range(10)]  # each has sixteen colours of its own, one of each place
    flat = np.concatenate(stretches).astype(np.uint8).tobytes()
    (a,), (b,) = stored(flat, flat[:1920] + flat[:1000] + flat[:920])
    assert webp.File(a).image.cache_bits == webp.File(b).image.cache_bits == webp.CACHE_BITS
    assert len(a) < 0.7 * len(flat) and len(b) < 0.6 * len(a) + 100
    plane = np.frombuffer(flat + flat, np.uint8)
    tile = np.repeat([0, 1], len(flat))
    key, hit = webp._cached(plane, tile, np.array([255, 0]))
    for t in (0, 1):
        held = {}
        for k in np.flatnonzero(tile == t).tolist():
            own = places[t][plane[k]]
            assert key[k] == own and hit[k] == (held.get(own) == plane[k])
            held[own] = plane[k]
