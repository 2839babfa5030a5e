"""Single-machine parts of the corpus operators against plain versions."""

import base64
import collections
import gzip
import io
import json
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
import xxhash

from factloom.llm import induced, language, media, packing, quality, secrets, sentencepiece, simhash, suffix_dedup

RNG = random.Random(5)
WORDS = "the of alpha Béta x, gamma.\ndelta ein zwei 42 ŝ 日本 token".split(" ")


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


# ------------------------------------------------------------------ packing


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.text_encoder(packing.vocabulary_path())
    odd = ["", " ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "\t x", "it's 12 o'clock<|endoftext|>", "é x 　y", "x\x1cy z"]
    for t in odd + [text(k) for k in range(0, 200, 7)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut_leaves_only_the_first_piece_short():
    assert packing.cut(5, 5) == [(0, 5)]
    assert packing.cut(6, 5) == [(0, 1), (1, 5)]
    assert packing.cut(10, 5) == [(0, 5), (5, 5)]


def test_fullest_filling_is_optimal():
    for _ in range(200):
        have = {RNG.randrange(1, 30): RNG.randrange(1, 4) for _ in range(RNG.randrange(0, 6))}
        room = RNG.randrange(0, 60)
        sums = {0}
        for x, n in have.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.fullest_filling(have, room)
        assert all(n <= have[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def test_bins_use_every_piece_once():
    histogram = {RNG.randrange(1, 100): RNG.randrange(1, 50) for _ in range(40)}
    patterns = packing.minimum_bin_slack(histogram, 100)
    used = collections.Counter()
    for bin_, times in patterns:
        assert sum(x * n for x, n in bin_.items()) <= 100
        for x, n in bin_.items():
            used[x] += n * times
    assert used == histogram
    lower = -(-sum(x * n for x, n in histogram.items()) // 100)
    assert sum(t for _, t in patterns) <= lower * 1.05 + 1


# ------------------------------------------------------------ sentencepiece


def plain_viterbi(codec, pieces, text_):
    """The best sum of scores, character by character."""
    marked = ("▁" + text_.replace(" ", "▁")) if text_ else ""
    scores = {p: s for p, s, kind in pieces if kind == sentencepiece.NORMAL}
    best = [0.0] + [float("-inf")] * len(marked)
    for i in range(len(marked)):
        for j in range(i + 1, min(len(marked), i + 16) + 1):
            if marked[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[marked[i:j]])
        if marked[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + codec.unknown_score)
    return best[-1]


def score_of(codec, pieces, ids):
    total, k = 0.0, 0
    while k < len(ids):
        if pieces[ids[k]][2] == sentencepiece.BYTE:
            lead = int(pieces[ids[k]][0][3:5], 16)
            k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            total += codec.unknown_score
        else:
            total, k = total + pieces[ids[k]][1], k + 1
    return total


def test_best_segmentation_and_round_trip():
    path = sentencepiece.model_path()
    pieces, codec = sentencepiece.read_pieces(path), sentencepiece.codec(path)
    texts = ["", " ", "a  b", " x ", "x" * 90, "tab\tnew\nline", "日本語😀é", "ab" * 60 + " c"] + [text(k) for k in range(1, 30)]
    for t, raw in zip(texts, codec.encode_batch(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert codec.decode(ids) == t
        assert score_of(codec, pieces, ids) == pytest.approx(plain_viterbi(codec, pieces, t)), t


def test_trie_finds_exactly_its_keys():
    keys = sorted({bytes(RNG.randrange(256) for _ in range(RNG.randrange(1, 5))) for _ in range(500)})
    trie = sentencepiece.DoubleArrayTrie(keys, list(range(len(keys))))

    def find(key):
        state = 0
        for c in key:
            t = trie.base[state] + c + 1
            if trie.check[t] != state:
                return -1
            state = t
        return trie.value[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"\0\1\2") == -1 for k in keys)


# ------------------------------------------------------------ suffix sorting


@pytest.mark.parametrize("block", [3, 1 << 15])
@pytest.mark.parametrize("budget", [64, 1 << 20])
def test_sorted_suffixes_and_their_common_prefixes(budget, block, monkeypatch):
    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(induced, "LONG_RUN", RNG.choice([2, 100]))
    for _ in range(150):
        k = RNG.choice([1, 2, 3, 26])
        t = [RNG.randrange(1, k + 2) for _ in range(RNG.randrange(0, 50))]
        t = np.array((t * 4)[:70] + [0] if RNG.random() < 0.3 else t + [0], dtype=np.int16)
        scratch = induced.Scratch(budget)
        order, common = (x.tolist() for x in induced.sorted_suffixes(t, int(t.max()) + 1, scratch))
        assert order == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for a, b, n in zip(order, order[1:], common[1:], strict=False):
            assert t[a : a + n].tolist() == t[b : b + n].tolist() and t[a + n] != t[b + n]
        assert budget > 64 or len(t) < 40 or scratch.spilled


def test_a_shard_far_larger_than_its_memory():
    base = [bytes(RNG.choice(b"abcdefgh ") for _ in range(300)) for _ in range(600)]
    parts = [c[: RNG.randrange(200, 300)] for c in base] + [c[RNG.randrange(0, 90) :] for c in base] + [b"-" * 280, b"-" * 250]
    shard = induced.Shard(1 << 14)
    for c in parts:
        shard.add(c)
    got = [x.tolist() for x in shard.repeated(200)]
    seen = collections.Counter(x[i : i + 200] for x in parts for i in range(len(x) - 199))
    assert got == [[i for i in range(len(x) - 199) if seen[x[i : i + 200]] > 1] for x in parts]
    assert shard.scratch.spilled > 100 * shard.scratch.budget


def test_repeated_windows():
    for _ in range(60):
        parts = [bytes(RNG.choice(b"ab") for _ in range(RNG.randrange(0, 40))) for _ in range(RNG.randrange(1, 6))]
        d = RNG.choice([3, 5, 8])
        seen = collections.Counter(x[i : i + d] for x in parts for i in range(len(x) - d + 1))
        want = [[i for i in range(len(x) - d + 1) if seen[x[i : i + d]] > 1] for x in parts]
        assert [x.tolist() for x in induced.repeated_windows(parts, d)] == want


def test_anchored_runs_cover_every_window_once():
    raw = [bytes(RNG.choice(b"abc ") for _ in range(n)) for n in (0, 199, 200, 201, 900, 3000)]
    for data, doc, begin, shift in suffix_dedup._segments(raw, 200):
        first, last, anchor, a, _ = suffix_dedup.anchored_runs(data, doc, 200, suffix_dedup.ANCHOR)
        windows = [(begin[doc[f]], w + shift[doc[f]]) for f, e in zip(first, last, strict=True) for w in range(f, e + 1)]
        assert sorted(windows) == [(k, w) for k, t in enumerate(raw) for w in range(len(t) - 199)]
        assert all(f <= p and e <= p and p + suffix_dedup.ANCHOR <= f + 200 for f, e, p in zip(first, last, anchor, strict=True))


def test_parted_contexts_hold_every_window_once():
    for length in (64, 65, 131, 199):
        for off in range(0, 200 - length + 1):
            for span in {0, off // 2, off}:
                one = lambda x: np.array([x])
                windows = []
                for which, side, f, s, o, n in suffix_dedup.halves(one(1000), one(span), one(off), one(length), 200):
                    for k in range(len(which)):
                        assert length < n[k] <= 200 and o[k] >= s[k] and o[k] + n[k] <= 200
                        windows += range(f[k], f[k] + s[k] + 1)
                assert sorted(windows) == list(range(1000, 1000 + span + 1))


# ------------------------------------------------------------------ simhash


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in ["", " \t", "a", "A b", "Ab  c\td\xa0e É f " * 100, " ".join(map(str, range(500)))] + [text(k) for k in range(0, 60, 9)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
        assert simhash.fingerprint(t, chunk=7) == plain_fingerprint(t)


def test_gray_rank_is_the_place_in_the_gray_sequence():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_gray_index_finds_all_near_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ flip() ^ flip() for _ in range(4))]))
    rng.shuffle(fps)
    groups = np.unique(rng.integers(0, 3, len(fps)), return_inverse=True)[1]
    got = {(min(x, y), max(x, y)) for a, b in simhash.GrayIndex(fps, groups).pairs(2) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2) & (groups[:, None] == groups[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


def test_masks_keep_every_pair_of_two_bits_together():
    for _ in range(300):
        x = RNG.getrandbits(64)
        y = x ^ (1 << RNG.randrange(64)) ^ (1 << RNG.randrange(64))
        assert any(x & m == y & m for m in simhash.MASKS)
        assert all(bin(m).count("1") == 32 and all(bin(f).count("1") == 48 for f in finer) for m, finer in simhash.MASKS.items())
        assert all(any(x & f == y & f for f in finer) for m, finer in simhash.MASKS.items() if x & m == y & m)


# ------------------------------------------------------------------ language


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 12, 40):
        code = language.codewords(k)
        distances = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(distances) >= (1 if k == 2 else 2)
        assert all(0 < s < k for s in code.sum(axis=0))


def test_predictions_do_not_depend_on_the_batch():
    names = ["aa", "bb", "cc"]
    rng = np.random.default_rng(1)
    model = language.fit(rng.integers(0, 50, (3, language.BUCKETS)).astype(float), names)
    texts = [None, "", "12 !?", "z", *(text(k) for k in range(1, 40))]
    lang, score, doubt = language.predict(model, texts)
    assert lang[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0]
    for k, t in enumerate(texts):
        one = language.predict(model, [t])
        assert (one[0][0], bool(one[2][0])) == (lang[k], bool(doubt[k])) and one[1][0] == pytest.approx(score[k])
    assert ((score >= 0) & (score <= 1)).all()


def test_one_flipped_bit_is_corrected():
    names = list("abcd")
    model = language.fit(np.ones((4, language.BUCKETS)), names)
    model.importance[:] = 1 / 7
    for k in range(4):
        for bit in range(7):
            margins = 6.0 * (2.0 * model.code[k] - 1)
            margins[bit] *= -0.5
            best, _, _ = language.decode(model, margins[None, :], np.array([1]))
            assert best[0] == k


# ------------------------------------------------------------------ media


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0"))
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IEND", b"")


def gif():
    image = b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00;"
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + image


def bmp():
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b" * 100)
    return out.getvalue()


def test_signatures_need_their_structure():
    items = [("application/zip", zipped()), ("image/png", png()), ("application/gzip", gzip.compress(b"hello" * 50)), ("image/gif", gif()), ("image/bmp", bmp())]
    blob, want = b"junk", []
    for kind, raw in items:
        want.append((kind, len(blob), len(raw)))
        blob += raw + b"xx"
    blob += b"BM RIFF GIF89a \x89PNG\r\n\x1a\n %PDF-1.4 OggS fLaC ftyp"
    assert [(f.kind, f.offset, f.length) for f in media.sniff(blob)] == want
    assert [b for _, b in media.carve(blob)] == [raw for _, raw in items]
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken)) == [] and media.sniff(b"") == []


def test_declared_types_are_corrected():
    found = media.sniff(png())
    assert media.corrected_type("image/gif", found) == "image/png"
    assert media.corrected_type("image/gif", []) == media.UNKNOWN
    assert media.corrected_type("text/plain", []) == "text/plain"
    assert media.corrected_type(None, []) == media.UNKNOWN


def test_wav_keeps_the_payload():
    for t in ["", "a", "x" * 63, "x" * 64, "é" * 100, "RIFF BM GIF89a"]:
        payload = media.padded(t)
        assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == t.encode().rstrip(b"\0")
        stored = media.to_wav(payload)
        assert media.wav_samples(stored) == payload
        assert media.sniff(stored)[0] == media.Found("audio/wav", 0, len(stored))
    inside = media.to_wav(media.padded("x") + png() + b"\0")
    assert [f.kind for f in media.sniff(inside)] == ["audio/wav", "image/png"]


# ------------------------------------------------------------------ quality


def walk(trees, row):
    total = trees.base
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        for _ in range(trees.depth):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return total


def test_trees_learn_and_walk_alike():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] < -0.2)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    assert np.allclose(trees.raw(x[:20]), [walk(trees, r) for r in x[:20]])


def test_degenerate_training():
    none = quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    assert none.score(np.zeros((2, len(quality.STATISTICS)))).tolist() == [0.5, 0.5]
    one = quality.fit(np.zeros((3, len(quality.STATISTICS))), np.ones(3))
    assert one.score(np.zeros((1, len(quality.STATISTICS))))[0] > 0.99


def test_statistics_of_any_text():
    for t in ["", " ", "a", "a a a", "\n\n", "é" * 1000, "x" * 100_000]:
        values = quality.statistics(t)
        assert len(values) == len(quality.STATISTICS) and np.isfinite(values).all()


# ------------------------------------------------------------------ secrets


def plain_base(t):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), "assign", m.end()))
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_base_spans_of_odd_texts():
    bits = ["token", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "xyz", "é", "ſecret", "\n", "deadbeef"]
    for _ in range(2000):
        t = "".join(RNG.choice(bits) for _ in range(RNG.randrange(0, 14)))
        assert [s for s in secrets.scan(t) if s[1] in secrets.BASE_KINDS] == plain_base(t), t


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + content


def rsa_key():
    number = lambda n: der(2, b"\x01" + bytes(range(1, n)))
    return der(0x30, der(2, b"\0") + number(128) + der(2, b"\1\0\1") + b"".join(number(60) for _ in range(6)))


def test_structures_are_confirmed():
    key = base64.b64encode(rsa_key()).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(key[i : i + 64] for i in range(0, len(key), 64)) + "\n-----END RSA PRIVATE KEY-----"
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    signed = f"{part(json.dumps({'alg': 'HS256'}).encode())}.{part(b'{}')}.{part(b'x' * 32)}"
    string = lambda b: struct.pack(">I", len(b)) + b
    ssh = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + struct.pack(">I", 1) + string(b"p" * 40) + string(b"q" * 80)
    hidden = base64.b64encode(b'password = "correct-horse-battery"').decode()
    public = base64.b64encode(der(0x30, der(0x30, der(6, b"\x2a\x86\x48")) + der(3, b"\0" * 65))).decode()
    t = f"a {key} b {pem} c {signed} d {base64.b64encode(ssh).decode()} e {hidden} f {rsa_key().hex().upper()} g {public}"
    kinds = [(k, t[a:b]) for a, k, b in secrets.scan(t) if k not in secrets.BASE_KINDS]
    assert [k for k, _ in kinds] == ["der", "pem", "token", "openssh", "encoded", "der"]
    assert kinds[1][1] == pem and kinds[2][1] == signed
    broken = base64.b64encode(rsa_key()[:-1]).decode()
    assert secrets.scan(f"x {broken} {signed[3:]} {'A' * 60}") == []


def test_redaction_covers_every_span():
    t = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y 9807915762804490 z'
    assert secrets.redacted(t) == 'x [REDACTED]" y [REDACTED] z'
    assert secrets.redacted(None) is None and secrets.redacted("") == "" and secrets.redacted("clean") == "clean"
