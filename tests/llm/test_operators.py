"""The corpus operators on small tables: odd rows, and plain versions of the whole result."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from factloom.llm import exact_dedup, language, media, packing, pii, quality, registry, secrets, sentencepiece, simhash, suffix_dedup

RNG = random.Random(11)
WORDS = "the of alpha Béta x, gamma.\ndelta ein zwei 42 ŝ und".split(" ")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name int, kept string, fingerprint string, score double"
SF = "/root/testdata/sf0.001"


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE = text(90)
SECRET = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y'
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a "), (6, " a"), (7, PASSAGE), (8, PASSAGE), (9, PASSAGE + "  "), (10, PASSAGE.replace(" ", "\n")),
    (11, text(30) + PASSAGE + text(30)), (12, "é" * 5000), (13, "1234 !!"), (14, SECRET), (14, SECRET), (None, "no id"), (None, None),
    (15, "Mr John Smith, jo@mail9.example.com 10.0.0.255 4485275742308327 +1 (017) 555-7713"), (16, "10.0.0.255 again, Mr Smith 4485275742308328"),
    (17, "y" * 199), (18, "z" * 1000), (19, text(3000)), (20, "w" * 9000 + "q"), (21, "w" * 9000 + "r"), (22, ("w" * 9000 + "q").replace("w", "w ")),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i is None or i % 5 == 0 else "en", None, len(t or ""), 1, "k", "f", 0.5) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fields(rows, *names):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    return sorted((tuple(r[n] for n in names) for r in rows), key=key)


# ------------------------------------------------------------------ packing


def test_packing(docs, none):
    got = packing.pack_documents(docs, capacity=64, with_ids=True).collect()
    encode = packing.encoder(packing.vocabulary_path())
    want = []
    for i, t in ROWS:
        ids = np.frombuffer(encode(t or ""), "<u4").tolist() + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want.append({"doc_id": i, "piece": k, "start": s, "length": n, "crc": zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())})
    assert fields(got, "doc_id", "piece", "start", "length", "ids_crc32") == fields(want, "doc_id", "piece", "start", "length", "crc")
    places = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 64) + 2
    assert packing.pack_documents(none).count() == 0


# ------------------------------------------------------------ sentencepiece


def test_sentencepiece(docs, none):
    got = sentencepiece.round_trips(docs).collect()
    assert len(got) == len(ROWS) and all(r["lossless"] for r in got)
    assert {r["n_ids"] for r in got if r["doc_id"] in (1, 2)} == {0}
    encoded = sentencepiece.encode_documents(docs)
    assert fields(sentencepiece.decode_documents(encoded).collect(), "doc_id", "text") == sorted(
        ((i, t or "") for i, t in ROWS), key=lambda x: ((x[0] is None, str(x[0])), (False, str(x[1])))
    )
    assert sentencepiece.round_trips(none).count() == 0


# ------------------------------------------------------------ suffix dedup


def plain_removal(rows, window=200):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b, end = (t or "").encode(), 0
        mask = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                mask[max(k, end) : k + window] = b"\1" * (k + window - max(k, end))
                end = k + window
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append({"doc_id": i, "n": len(b), "r": sum(mask), "s": len([x for x in bytes(mask).split(b"\0") if x]), "h": hashlib.sha256(kept).hexdigest()})
    return out


@pytest.mark.parametrize("hot", [2048, 1])
def test_suffix_dedup(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    got = suffix_dedup.remove_repeats(docs).collect()
    want = plain_removal(ROWS)
    assert fields(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == fields(want, "doc_id", "n", "r", "s", "h")
    assert suffix_dedup.remove_repeats(none).count() == 0


def _plain_removed(texts, window=200):
    """For each text, the bytes covered by windows that start more than once."""
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone.update(range(i, i + window))
        out.append(bytes(b for k, b in enumerate(t) if k not in gone))
    return out


@pytest.mark.parametrize(("limit", "bits"), [(3, 64), (2048, 64), (2048, 2)])
def test_suffix_dedup_with_a_hot_anchor(spark, monkeypatch, limit, bits):
    """One passage between ever other neighbours; small parts, and digests that collide at first."""
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", limit)
    monkeypatch.setattr(suffix_dedup, "FIRST_DIGEST_BITS", bits)
    word = lambda n: "".join(RNG.choice("abcdefgh ") for _ in range(n))
    passage, left, right = word(90), [word(140) for _ in range(6)], [word(140) for _ in range(6)]
    rows = [(k, RNG.choice(left)[RNG.randrange(30) :] + passage + RNG.choice(right)[: RNG.randrange(110, 140)] + word(20)) for k in range(60)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    want = _plain_removed([t.encode() for _, t in rows])
    assert [got[k] for k in range(60)] == want and any(want)


def test_suffix_dedup_on_many_overlaps(spark):
    passage = text(100)
    rows = [(i, text(20) + passage[RNG.randrange(200) :] + text(10)) for i in range(60)] + [(99, text(9) + ("ab" * 300) + passage[:260] * 2)]
    kept = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert fields(kept, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == fields(plain_removal(rows), "doc_id", "n", "r", "s", "h")
    for r in kept:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


# ------------------------------------------------------------ exact dedup


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append({"doc_id": i, "keep_id": keep, "group_size": len(groups[norm]), "sha": hashlib.sha256(norm.encode()).hexdigest()})
    return out


@pytest.mark.parametrize("block", [4096, 16, 1000])
def test_exact_dedup(docs, none, block):
    got = exact_dedup.exact_groups(docs, block_chars=block).collect()
    assert fields(got, "doc_id", "keep_id", "group_size", "text_sha256") == fields(plain_groups(ROWS), "doc_id", "keep_id", "group_size", "sha")
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_dedup_keeps_columns(docs):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0d]", "", t or "") for _, t in ROWS})
    assert kept.filter("doc_id = 14").count() == 1


def test_exact_dedup_starts_again_on_a_collision(docs, monkeypatch):
    real = exact_dedup._key

    def weak(block, seed):
        return real(block, seed) if seed else real(exact_dedup.F.lit("same"), 0)

    monkeypatch.setattr(exact_dedup, "_key", weak)
    got = exact_dedup.exact_groups(docs).collect()
    assert fields(got, "doc_id", "keep_id", "group_size") == fields(plain_groups(ROWS), "doc_id", "keep_id", "group_size")


# ------------------------------------------------------------------ simhash


def plain_components(rows):
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                parent[root(a)] = root(b)
    members = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[root(k)].append(i)
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return [{"doc_id": i, "fingerprint": f"{fps[k]:016x}", "component_id": least[root(k)]} for k, (i, _) in enumerate(rows)]


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert fields(got, "doc_id", "fingerprint", "component_id") == fields(plain_components(ROWS), "doc_id", "fingerprint", "component_id")
    assert sum(r["kept"] for r in got) == len({(r["component_id"], r["fingerprint"] if r["component_id"] is None else "") for r in got})
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.deduplicate(docs).columns == docs.columns


@pytest.mark.parametrize("split_over", [512, 2])
def test_chains_of_links(spark, split_over):
    at, chain = RNG.getrandbits(64), []
    for _ in range(40):  # each two bits from the last; the ends far apart
        chain.append(at)
        at ^= 1 << RNG.randrange(64) | 1 << RNG.randrange(64)
    star = [chain[0] ^ (1 << b) for b in range(64)]
    far = [RNG.getrandbits(64) for _ in range(50)]
    signed = [(simhash._signed(x),) for x in {*chain, *star, *far, 0}]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), split_over=split_over)
    roots = {r["node"]: r["root"] for r in simhash.components(spark, edges).collect()}
    least = min(simhash._signed(x) for x in [*chain, *star])
    assert {roots.get(simhash._signed(x), simhash._signed(x)) for x in [*chain, *star]} == {least}
    assert all(simhash._signed(x) not in roots for x in far)


# ------------------------------------------------------------------ PII


def test_surrogates(docs, none):
    got = {(r["doc_id"], r["text"]): r for r in pii.replace_personal_data(docs, "k").collect()}
    by_id = {i: r for (i, _), r in got.items() if i is not None}
    one, two = by_id[15], by_id[16]
    original = dict(ROWS)
    assert one["spans"] == "name:0:13,email:15:35,ip:36:46,card:47:63,phone:64:81"
    assert two["spans"] == "ip:0:10,name:18:26" and "4485275742308328" in two["text"]
    assert not any(x in one["text"] for x in ("Smith", "John", "jo@", "10.0.0.255", "4485275742308327", "555-7713"))
    kept = re.fullmatch(r"Mr (\w+) (\w+), ([a-z]{2}@[a-z]{4}\d\.[a-z]{7}\.com) (\d\d?\.\d\.\d\.\d{3}) (4\d{15}) (\+1 \(\d{3}\) \d{3}-\d{4})", one["text"])
    assert kept
    digits = [int(c) for c in kept[5]][::-1]
    assert (sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert two["text"].startswith(f"{kept[4]} again, Mr {kept[2]} ")
    for i, t in ROWS:
        if i not in (15, 16) and i is not None:
            assert by_id[i]["text"] == (original[i] or "") and by_id[i]["n_entities"] == 0, i
    again = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(docs, "k").collect()}
    assert again[15] == one["text"]
    assert {r["doc_id"]: r["text"] for r in pii.replace_personal_data(docs, "other").collect()}[15] != one["text"]
    assert pii.replace_personal_data(none).count() == 0


def test_surrogates_stay_distinct(spark):
    """A full class of short addresses: collisions must occur, and must be resolved."""
    values = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)] * 1
    entities = spark.createDataFrame([("ip", v) for v in values] + [("surname", w) for w in {"Ab", "Cd", "Ef", "ИВ"}], "kind string, value string")
    got = pii.surrogates(entities, "k").collect()
    for kind in ("ip", "surname"):
        made = [r["surrogate"] for r in got if r["kind"] == kind]
        real = [r["value"] for r in got if r["kind"] == kind]
        assert len(set(made)) == len(made) == len(real) and not set(made) & set(real)
    assert all(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", r["surrogate"]) for r in got if r["kind"] == "ip")


def test_names_follow_script_and_gender(spark):
    rows = [(1, "Frau Anna Weber; Herr Anna Weber; Господин Иван Петров; Κυρία Μαρία Παππά; Dr WEBER")]
    out = pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "k").first()["text"]
    a, b, c, d, e = out.split("; ")
    assert a.split()[2] == b.split()[2] and a.split()[1] != b.split()[1]
    assert a.split()[1].endswith(("a",)) and b.split()[1].endswith(("n", "o"))
    assert re.fullmatch(r"Господин [а-яА-Я]+ [а-яА-Я]+", c) and re.fullmatch(r"Κυρία [α-ωΑ-Ως]+ [α-ωΑ-Ως]+", d)
    assert e.split()[1].isupper()


# ------------------------------------------------------------------ language, media, quality, secrets


def test_language(spark, docs, none):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.queries()["op7_language_id"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in real.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9
    model = language.train(real)
    odd = {r["doc_id"]: r for r in language.identify(docs.select("doc_id", "text"), model).collect()}
    assert [odd[i]["_factloom_lang_pred"] for i in (1, 2, 3, 13)] == ["und"] * 4
    assert language.train(none).languages == []
    assert language.identify(docs, language.train(none)).filter("_factloom_lang_pred <> 'und'").count() == 0
    assert language.keep_identified(none).count() == 0
    assert language.keep_identified(docs).columns == docs.columns


def test_media(docs, none):
    stored = media.store_payloads(docs)
    got = media.describe_media(stored, ["doc_id", "n_bytes"]).collect()
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append({"doc_id": i, "n": len(b), "p": len(p), "s": hashlib.sha256(p).hexdigest(), "c": zlib.crc32(p[-64:])})
    assert fields(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == fields(want, "doc_id", "n", "p", "s", "c")
    assert {r["kind"] for r in got} == {"audio/wav"}
    assert len({(r["payload_sha256"], r["feature"], r["media_sha256"]) for r in got}) == len({r["payload_sha256"] for r in got})
    assert media.describe_media(media.store_payloads(none), ["doc_id"]).count() == 0


def test_quality(spark, docs, none):
    got = registry.queries()["op9_quality"](spark, "/root/testdata/sf0.01").collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 30 and np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 0), (9, None), (None, 1), (19, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score_quality(docs, model).count() == len(ROWS)
    assert quality.score_quality(docs, quality.train(docs, labels.limit(0))).select("score").distinct().collect()[0][0] == 0.5
    assert quality.score_quality(none, model).count() == 0


def test_secrets(docs, none):
    got = fields(secrets.find_secrets(docs).collect(), "doc_id", "spans")
    want = fields([{"doc_id": i, "spans": [secrets._SPAN and (k, a, b) for a, k, b in secrets.scan(t or "")]} for i, t in ROWS], "doc_id", "spans")
    assert [(i, [tuple(s) for s in spans]) for i, spans in got] == want
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.filter("text like '%04dbebab%'").count() == 0
    assert clean.filter("n_chars <> char_length(text)").count() == 0 and clean.filter("text is null").count() == 2
    assert secrets.find_secrets(none).count() == 0 and secrets.redact(none).count() == 0


# ------------------------------------------------------------------ registered queries and the pipeline


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")}) == list(range(1, 11)) and "pipeline" in names


def test_secret_query_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.queries()["op10_secret_scan"](spark, SF).collect():
        spans = secrets.scan(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for a, k, b in spans if k in secrets.BASE_KINDS)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"] == ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def plain_near_copies(rows):
    """The smallest id of each component of texts whose five-word shingles have a Jaccard similarity of 4/5 or more."""
    sets = []
    for i, t in rows:
        words = t.encode().lower().split()
        sets.append((i, {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in root}


def test_pipeline_against_a_plain_version(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    rows = [(i, t) for i, t in rows if language.has_letter(t)]
    keep = {g["keep_id"] for g in plain_groups(rows)}
    rows = [(i, t) for i, t in rows if i in keep]
    keep = plain_near_copies(rows)
    rows = [(i, secrets.redacted(t)) for i, t in rows if i in keep]
    encode, want = packing.text_encoder(packing.vocabulary_path()), []
    for i, t in rows:
        ids = encode(t) + np.array([2], "<u4").tobytes()
        want += [{"doc_id": i, "piece": k, "start": s, "length": n, "crc": zlib.crc32(ids[4 * s : 4 * (s + n)])} for k, (s, n) in enumerate(packing.cut(len(ids) // 4, 1024))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert fields(got, "doc_id", "piece", "start", "length", "ids_crc32") == fields(want, "doc_id", "piece", "start", "length", "crc")
    used = collections.Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


def test_stages_take_odd_tables(spark, docs, none, tmp_path):
    for table in (docs, none):
        now = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = f"{tmp_path}/{table is docs}-{k}"
            stage(spark, now, SF).write.parquet(out)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert spark.read.parquet(out).columns == table.columns, name
            now = spark.read.parquet(out)
