"""Operators on texts against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, fingerprint, packing, pii, simhash, token_counts, tokens
from tests.llm.conftest import broadcasts, got, prose


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def plain_encoding():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_file_gives_the_ids_of_the_json_vocabulary():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    json = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    json.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["", "<|endoftext|> x", "a" * 3000, " " * 300 + "\n\n x", prose(4, 200)]
    texts += ["".join(chr(rng.choice([rng.randrange(9, 127), rng.randrange(128, 0x3000), rng.randrange(0xE000, 0x20000), 0x85, 0xA0, 32])) for _ in range(30)) for _ in range(400)]
    for t in texts:
        ids = json.encode(t, add_special_tokens=False).ids
        assert tokens.encoding().encode_ordinary(t) == ids
        assert [x for w in tokens.pattern().findall(t) for x in tokens.encoding().encode_ordinary(w)] == ids


def test_bpe(docs, rows, empty, plain_encoding):
    want = []
    for i, t in rows:
        ids = plain_encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got(bpe.digests(docs), *columns) == sorted(want, key=repr)
    assert bpe.digests(empty).count() == 0
    small = bpe.encode(docs, block=50, dictionary=20)  # many blocks and chunks
    assert got(small, "doc_id", "n_tokens") == sorted(((i, n) for i, n, *_ in want), key=repr)
    round_trip = bpe.decode(small).collect()
    assert sorted(bytes(r["data"]) for r in round_trip) == sorted((t or "").encode() for _, t in rows)


def test_token_counts(docs, rows, empty, plain_encoding):
    sizes = Counter(len(plain_encoding.encode_ordinary(t or "")) for _, t in rows)
    sums = token_counts.count_tokens(docs)
    want = []
    for size, n in sizes.items():
        longer = {s: m for s, m in sizes.items() if s >= size}
        cut = sum(min(s, size) * m for s, m in sizes.items())
        want.append((size, n, sum(longer.values()), sum(s * m for s, m in longer.items()), cut))
    assert got(sums, "n_tokens", "n_docs", "docs_from", "tokens_from", "truncated_total") == sorted(want, key=repr)
    limits = [1, 3, 50, 51, 10**6]
    want = sorted((x, sum(min(s, x) * m for s, m in sizes.items()), sum(m for s, m in sizes.items() if s > x)) for x in limits)
    assert sorted(tuple(r) for r in token_counts.at_limits(sums, limits).collect()) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_packing(docs, rows, empty, plain_encoding):
    window = 64
    out = packing.pack(docs, window=window, group=5).collect()
    want = Counter()
    for i, t in rows:
        ids = [*plain_encoding.encode_ordinary(t or ""), 1]
        for s in range(0, len(ids), window):
            want[i, s, len(ids), np.array(ids[s : s + window], dtype="<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], bytes(r["ids"])) for r in out) == want
    windows: dict[int, list] = {}
    for r in out:
        assert r["length"] == len(r["ids"]) // 4
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    digests = packing.packed_digests(docs).collect()
    assert {r["ids_crc32"] for r in digests if r["length"] == 1} == {zlib.crc32(b"\1\0\0\0")}
    assert packing.packed_digests(empty).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 101) for _ in range(500)), reverse=True)
    windows, plain = packing.OpenWindows(100), []
    for n in lengths:
        number, offset = windows.place(n)
        fits = [(100 - used, k) for k, used in enumerate(plain) if 100 - used >= n]
        if fits:
            assert 100 - plain[number] == min(fits)[0] and offset == plain[number]
            plain[number] += n
        else:
            assert number == len(plain) and offset == 0
            plain.append(n)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(docs, rows, empty):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    seen, want = set(), []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        kept = i == keep and (i, norm(t)) not in seen
        seen.add((i, norm(t)))
        want.append((i, keep, len(ids), kept, sha(norm(t))))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for leaves, fan_in in ((None, 8), (1, 2), (5, 2)):
        assert got(exact_dedup.exact_groups(docs, leaves, fan_in), *columns) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0 == exact_dedup.keep_first(empty).count()
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert got(kept, "doc_id", "text") == sorted({(i, t) for (i, t), w in zip(rows, want) if w[3]}, key=repr)


def test_simhash_keys_and_points_are_not_broadcast(spark):
    """A node has some 16 keys or 65 points, which Spark takes for as large as the nodes."""
    nodes = spark.range(0, 3000, 1, 4).select((F.col("id") * 7919).alias("fp")).distinct()
    assert broadcasts(simhash.links(nodes)) == 0 == broadcasts(simhash.ball_links(nodes))
    docs = spark.createDataFrame([(i, prose(i, 9)) for i in range(50)], "doc_id long, text string")
    assert broadcasts(simhash.near_groups(docs)) == 0 == broadcasts(simhash.keep_one(docs))


def test_simhash_fingerprint_by_the_definition():
    import xxhash

    for text in ["", "one", "One two", "a b c d a b c", prose(9, 300), "café İ x\x0by"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert simhash.simhash(text) == want


def test_golay_keys_meet():
    table = simhash.golay_errors()
    assert {bin(int(e)).count("1") for e in table[:, 0]} == {0, 1, 2, 3}
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 20000)
    for flip in [0, *(1 << np.arange(23))]:
        a, b = simhash.golay_indices(v, table), simhash.golay_indices(v ^ flip, table)
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def plain_components(fps: list[int]) -> dict[int, int]:
    fps, label = sorted(set(fps)), {}
    for f in fps:
        if f in label:
            continue
        label[f], todo = f, [f]
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in label and bin((x ^ y) & (2**64 - 1)).count("1") <= 2:
                    label[y] = f
                    todo.append(y)
    return label


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_lose_nothing(spark, bucket):
    """Chains of near fingerprints, some in buckets over the bound, which take the exact path."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(150):
        f = rng.choice(fps)
        for _ in range(rng.randrange(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, bucket)).collect()}
    want = plain_components(signed)
    sizes = Counter(want.values())
    assert found == {f: c for f, c in want.items() if sizes[c] > 1}


def test_near_groups(docs, rows, empty):
    fps = [simhash.simhash(t or "") for _, t in rows]
    label = plain_components(fps)
    least: dict[int, int] = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    want = sorted(((i, format(f, "016x"), least.get(label[f])) for (i, _), f in zip(rows, fps)), key=repr)
    assert got(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and simhash.keep_one(empty).count() == 0 == simhash.near_groups(empty).count()
    assert {r["doc_id"] for r in kept.collect()} == {i for (i, _), f in zip(rows, fps) if i is None or least[label[f]] == i}


def plain_order_minhash(text: str, k: int, sketches: int) -> list[int]:
    """By the definition: numbered k-mers, the two of the smallest draws, in text order, hashed."""
    k = min(k, len(text))
    mers = [text[i : i + k] for i in range(len(text) - k + 1)] if text else []
    if not mers:
        return [0] * sketches
    hashed = {m: int(fingerprint.kmers(m, k)[0]) for m in set(mers)}
    mask, seen, element = (1 << 64) - 1, Counter(), []

    def mix(x: int) -> int:
        return int(fingerprint._mix(np.array([x & mask], dtype=np.uint64))[0])

    for m in mers:
        element.append(mix(hashed[m] + seen[m] * 0x9E3779B97F4A7C15) >> 32)
        seen[m] += 1
    masks, factors = fingerprint._seeds(sketches)
    out = []
    for x, f in zip(masks.tolist(), factors.tolist()):
        draw = [((e ^ x) * f) & 0xFFFFFFFF for e in element]
        first = min(range(len(draw)), key=lambda i: (draw[i], i))
        second = min((i for i in range(len(draw)) if i != first), key=lambda i: (draw[i], i), default=first)
        early, late = mers[min(first, second)], mers[max(first, second)]
        out.append(mix(hashed[early] * 3 + mix(hashed[late])) >> 48)
    return out


@pytest.mark.parametrize("text", ["", "a", "ab", "abcabcabcabc", prose(5, 40), "naïve 你好 \U0001f600 naïve 你好 \U0001f600 again"])
def test_order_minhash_by_the_definition(text):
    assert fingerprint.order_minhash(text, 5, 16).tolist() == plain_order_minhash(text, 5, 16)


def in_order(rows):
    """By doc_id, nulls first, then by the hash of the text."""
    import xxhash

    def key(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h

    return sorted(rows, key=key)


def test_fingerprints(docs, rows, empty):
    order = in_order(rows)
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        a, b, c = (fingerprint.order_minhash(x) for x in (t, changed, following))
        want.append((i, len(t), sha(changed), a.tobytes().hex(), b.tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert got(fingerprint.fingerprints(docs), *columns) == sorted(want, key=repr)
    assert fingerprint.fingerprints(empty).count() == 0
    one = docs.where("doc_id = 22").limit(1)
    assert fingerprint.fingerprints(one).first()["near_next"] == 1.0


@pytest.mark.parametrize("big", [2**40, 2**62])
def test_a_hot_id_spans_ranges(spark, big):
    """Two ids and null, a third of the rows each; ids that doubles can't tell apart still keep their order."""
    rows = [(None if i % 3 == 0 else big + i % 3, f"text {i}") for i in range(900)] + [(big - 1, "x"), (5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = in_order(rows)
    want = Counter((i, sha(t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2])) for k, (i, t) in enumerate(order))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        placed = fingerprint.with_successors(docs).where("extra = 0").groupBy("range").count().collect()
        assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprint.fingerprints(docs).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert big > 2**53 or len(placed) >= 9 and max(r["count"] for r in placed) < 200


def test_order_minhash_feels_order_and_edits():
    text = prose(11, 600)
    words = text.split()
    swapped = " ".join(words[300:] + words[:300])
    light = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    mark = fingerprint.order_minhash(text)
    assert fingerprint.likeness(mark, fingerprint.order_minhash(light)) > 0.3
    assert 0.2 < fingerprint.likeness(mark, fingerprint.order_minhash(swapped)) < 0.85
    assert fingerprint.likeness(mark, fingerprint.order_minhash(prose(12, 600))) < 0.1
    assert (fingerprint.occurrences(np.array([5 << 40, 7 << 40, 5 << 40, 5 << 40, 7 << 40], dtype=np.uint64)) == [0, 0, 1, 2, 1]).all()
    mers = fingerprint.kmers("abcabcabc", 3)
    assert len(mers) == 7 and len(set(mers.tolist())) == 3 and mers[0] == mers[3] == mers[6]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii(spark, docs, rows, empty):
    rng = random.Random(8)
    pieces = ["a@b.co", "x", "@", ".", " ", "1.2.3.4", "255.256.1.1", "4111111111111111", "+1 640 555 0953", "-", "%", "12", "\U0001f600", "\n", "(", "0000004.3.2.1"]
    extra = [(10_000 + k, "".join(rng.choices(pieces, k=25))) for k in range(300)]
    both = spark.createDataFrame([*rows, *extra], "doc_id long, text string")
    want = []
    for i, t in [*rows, *extra]:
        spans = base_spans(t or "")
        counts = Counter(kind for *_, kind in spans)
        want.append((i, *(counts[k] for k in PATTERNS), sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans))))
    found = pii.span_digests(both)
    assert got(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    for r in found.collect():
        spans = [(int(s.split(":")[1]), s.split(":")[0], int(s.split(":")[2])) for s in r["spans"].split(",") if s]
        assert [(a, pii.KINDS.index(k)) for a, k, _ in spans] == sorted((a, pii.KINDS.index(k)) for a, k, _ in spans)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert pii.span_digests(empty).count() == 0 == pii.redact(empty).count()


def test_redaction(docs, rows):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r["text"] for r in out.collect()}
    assert "Mail [EMAIL], ip 10.0.0.300 and [IP], card [CARD], call [PHONE]!" in texts and None in texts
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())
    untouched = {t for _, t in rows if t is not None and not base_spans(t) and "token" not in t}
    assert untouched <= texts


IBANS = """AT611904300234573201 BE68539007547034 CH9300762011623852957 DE89370400440532013000 DK9520000123456789
ES9121000418450200051332 FI2112345600000785 FR1420041010050500013M02606 GB29NWBK60161331926819 IE29AIBK93115212345678
IT60X0542811101000000123456 LU280019400644750000 NL91ABNA0417164300 NO9386011117947 PL61109010140000071219812874
PT50000201231234567890154 SE4550000000058398257466""".split()


def test_ibans_and_secrets_are_redacted_whole(spark):
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in IBANS]
    assert {x[:2] for x in IBANS} == set(re.findall("[A-Z]{2}", pii.COUNTRIES))
    jwt = "eyJhbGciOi" + hashlib.sha256(b"x").hexdigest() * 31 + "-_/+.a"
    assert len(jwt) == 2000
    texts = [(f"Pay to IBAN {x} I say, today", "Pay to IBAN [IBAN] I say, today") for x in [*IBANS, *spaced]]
    texts += [(f"{x}.", "[IBAN].") for x in [*IBANS, *spaced]]
    texts += [(f"the token={x} is old", "the [SECRET] is old") for x in (jwt, jwt[:300], jwt[:128], jwt[:60])]
    docs = spark.createDataFrame(list(enumerate(t for t, _ in texts)), "doc_id long, text string")
    assert got(pii.redact(docs), "doc_id", "text") == sorted(((i, t) for i, (_, t) in enumerate(texts)), key=repr)


def test_running_values(spark):
    rng = random.Random(5)
    arrays = [[rng.randrange(-50, 50) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 4095, 4096, 4097, 9000)]
    rows = spark.createDataFrame(list(enumerate(arrays)), "doc_id int, v array<int>")
    for join, plain in ((lambda a, b: a + b, lambda a, b: a + b), (pii._larger, max)):
        found = got(rows.select("doc_id", pii.running(pii.F.col("v"), join).alias("r")), "doc_id", "r")
        assert [r for _, r in sorted(found)] == [list(accumulate(a, plain, initial=0))[:-1] for a in arrays]


def test_proposals_apart_from_base_spans_and_their_redaction(spark):
    """Overlaps and cuts against plain loops, with characters beyond 16 bits and byte order marks."""
    rng = random.Random(9)
    pieces = ["a@b.co", "1.2.3.4", "4111111111111111", "+1 640 555 0953", "123-45-6789", "640-555-0953", "DE89370400440532013000", "token=abcdef123456", "Anna Berger",
              " ", " ", " ", ".", "-", "\U0001f600", "\ufeff", "é", "A"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    F = pii.F
    each = docs.select("doc_id", pii.candidates(F.col("text")).alias("all"), pii.found(F.col("text"), pii.PROPOSE).alias("proposed"))
    kept = 0
    for r in each.collect():
        base = [s for s in r["all"] if s["no"] <= 4]
        want = [(s["start"], s["end"]) for s in r["proposed"] if not any(b["start"] < s["end"] and s["start"] < b["end"] for b in base)]
        assert [(s["start"], s["end"]) for s in r["all"] if s["no"] > 4] == want and r["all"] == sorted(r["all"])
        kept += len(want) not in (0, len(r["proposed"]))
    assert kept > 20
    clean = dict(got(pii.redact(docs), "doc_id", "text"))
    for r in pii.detect(docs).collect():
        text, out, at = texts[r["doc_id"]], "", 0
        for s in r["spans"]:
            if s["start"] >= at:
                out += f"{text[at : s['start']]}[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert clean[r["doc_id"]] == out + text[at:]


@pytest.mark.parametrize("unit, count, clean", [("10.1.2.3 123-45-6789 ", "n_ip", "[IP] [SSN] "), ("a.b@", "n_email", "[EMAIL]@")])
def test_pii_of_a_text_with_very_many_spans(spark, unit, count, clean):
    n = 400_000 // len(unit)
    docs = spark.createDataFrame([(1, unit * n), (2, "x")], "doc_id long, text string")
    spans = n // (2 if "@" in unit else 1)
    assert got(pii.span_digests(docs), "doc_id", count) == [(1, spans), (2, 0)]
    assert got(pii.redact(docs), "doc_id", "text") == [(1, clean * spans), (2, "x")]


def test_weak_supervision_learns_reliabilities():
    counts = {("ssn", "+0+0"): 60, ("ssn", "+000"): 40, ("ssn", "-00-"): 50, ("iban", "--00"): 30, ("iban", "++00"): 30, ("ip", "+000"): 900, ("card", "++00"): 500}
    found = pii.posteriors(counts)
    assert found["ssn", "+0+0"] > found["ssn", "+000"] > 0.5 > found["ssn", "-00-"] and found["iban", "++00"] > 0.9 > 0.1 > found["iban", "--00"]
    assert found["ip", "+000"] > 0.9 and found["card", "++00"] > 0.9  # checked spans are likely true, context or not
    weights = pii.train([(k, v, f, n) for (k, v), n in counts.items() for f in ("", "form=" + v[0], "same=1")])
    assert weights["ssn", "form=+"] > 0 > weights["ssn", "form=-"] and abs(weights["ssn", "same=1"]) < 0.1 and weights["ip", ""] > 2
    assert pii.posteriors({}) == {} == pii.train([])


def labelled_texts(seed: int, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with planted spans of the added kinds, true ones and look-alikes."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    key = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def iban(good: bool) -> str:
        body = rng.choice(["DE", "NL"]) + "00" + (digits(18))
        body = body if body[:2] == "DE" else "NL00ABNA" + digits(10)
        turned = "".join(str(int(c, 36)) for c in body[4:] + body[:4])
        check = 98 - int(turned) % 97
        return body[:2] + f"{check if good else (check + rng.randrange(1, 90)) % 97:02}" + body[4:]

    true = {
        "ssn": lambda: (rng.choice(["SSN ", "social security: ", ""]), f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        "iban": lambda: (rng.choice(["IBAN ", "Konto: ", ""]), iban(True)),
        "local": lambda: (rng.choice(["call ", "Tel: ", "phone ", ""]), f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digits(4)}"),
        "secret": lambda: ("", rng.choice([f"token={key(40)}", f'password = "{key(20)}"', f"api_key: {key(32)}"])),
        "name": lambda: (rng.choice(["", "by ", "dear "]), rng.choice(["Dr. Martin Luther", "Mrs. Olga Stern", "Anna Berger", "Herr Klaus Maier", "Sophie Martel"])),
    }
    false = {
        "ssn": lambda: (rng.choice(["part no. ", "order # "]), f"{rng.choice(['000', '666', '912'])}-{rng.randrange(10, 99)}-{digits(4)}"),
        "iban": lambda: ("serial ", "XQ" + digits(2) + " " + digits(4) + " " + digits(4) + " " + digits(4)),
        "local": lambda: ("version ", f"{rng.randrange(100, 199)}.{rng.randrange(100, 199)}.{digits(4)}"),
        "secret": lambda: ("", rng.choice(["password: changeme", "secret: yourself", "token = placeholder"])),
    }
    out = []
    for _ in range(n):
        kind, good = rng.choice([(k, True) for k in true] * 2 + [(k, False) for k in false])
        before, value = (true if good else false)[kind]()
        lead = f"some {rng.choice(['plain', 'quiet', 'green'])} words "
        text = f"{lead}{before}{value} and more."
        start = len(lead + before)
        out.append((text, [(kind, start, start + len(value))] if good else []))
    return out


def test_added_spans_precision_and_recall(spark):
    """Trained without labels; measured on planted spans."""
    texts = labelled_texts(1, 600)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = pii.span_digests(docs).collect()
    hits = wrong = 0
    missed = Counter()
    for r in found:
        spans = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)}
        want = set(texts[r["doc_id"]][1])
        assert r["n_added"] == sum(k in pii.ADDED for k, *_ in spans)
        hits += len(spans & want)
        wrong += len(spans - want)
        missed.update(k for k, *_ in want - spans)
    total = sum(len(w) for _, w in texts)
    print("precision", hits / (hits + wrong), "recall", hits / total, missed)
    assert hits >= 0.95 * total and hits >= 0.95 * (hits + wrong)


def test_checked_base_kinds_have_positive_odds(spark):
    """On the test table, where hardly any base span has words before it."""
    from tessera.llm import common

    spans = common.texts(common.table(spark, "/root/testdata/sf0.01", "documents")).select(pii.candidates(pii.F.col("text")).alias("spans")).cache()
    weights = pii.train(pii.pattern_counts(spans))
    odds = spans.select(pii.F.explode("spans").alias("s")).select("s.kind", pii.odds(pii.F.col("s"), weights).alias("z")).groupBy("kind").agg(pii.F.min("z").alias("z"))
    assert {r["kind"]: r["z"] > 0 for r in odds.collect()}.items() >= {k: True for k in (*pii.BASE, "secret")}.items()


def test_tree_merge_of_sorted_runs(spark):
    """The merge itself against a dictionary, and its place in the plan."""
    rng = random.Random(4)
    rows = sorted({(sha(str(rng.randrange(400))), rng.randrange(2), 3) for _ in range(600)})
    runs = [[(*r, rng.choice([None, rng.randrange(99)]), 1) for r in sorted(rng.sample(rows, 150))] for _ in range(9)]
    blocks = sorted(((run[i][0], iter(run[i : i + 7])) for run in runs for i in range(0, 150, 7)), key=lambda b: b[0])
    want: dict[tuple, list] = {}
    for row in (r for run in runs for r in run):
        want.setdefault(row[:3], []).append(row[3])
    found = list(exact_dedup.collapse(exact_dedup.merge_blocks(iter(blocks))))
    assert found == [(*d, min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in sorted(want.items())]
    leaves = spark.createDataFrame([(k, *r) for k, run in enumerate(runs) for r in run], "node long, " + exact_dedup.MERGED)
    merged = exact_dedup.merge_runs(leaves, 9, 3)
    assert sorted(tuple(r) for r in merged.collect()) == found
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Sort [shard") == 3 and "HashAggregate" not in plan


LONG = [c * 10**6 for c in (" ", "\t", "\n", "x", ".", "1", "é")] + ["end" + " \n" * 10**6 + "x"]


def test_texts_of_a_million_characters(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    json = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    json.encode_special_tokens = True
    ids = [json.encode(t, add_special_tokens=False).ids for t in LONG]
    assert [tokens.encode(t) for t in LONG] == ids
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(t)) for i, (x, t) in enumerate(zip(ids, LONG))]
    assert got(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert got(token_counts.lengths(docs), "doc_id", "n_tokens") == sorted(((i, n) for i, n, *_ in want), key=repr)
    packed = packing.packed_digests(docs).groupBy("doc_id").sum("length").collect()
    assert sorted(tuple(r) for r in packed) == [(i, n + 1) for i, n, *_ in want]


def test_packing_spreads_a_hot_id(spark):
    docs = spark.createDataFrame([(None if i % 2 else 5, prose(i, 6)) for i in range(400)], "doc_id long, text string")
    groups = Counter(r["sequence_id"] >> 32 for r in packing.pack(docs, group=20).collect())
    assert len(groups) == 20 and max(groups.values()) < 50
    shuffled = docs.repartition(7, "text")
    columns = ("doc_id", "ids", "sequence_id", "offset")
    assert got(packing.pack(docs, group=20), *columns) == got(packing.pack(shuffled, group=20), *columns)


def test_token_quantiles(docs, rows, empty, plain_encoding):
    sizes = sorted(len(plain_encoding.encode_ordinary(t or "")) for _, t in rows)
    shares = [0.01, 0.25, 0.5, 0.9, 1.0]
    found = token_counts.quantiles(token_counts.count_tokens(docs), shares).collect()
    assert [tuple(r) for r in found] == [(q, min(s for s in sizes if sum(x <= s for x in sizes) >= q * len(sizes))) for q in shares]
    assert {r["n_tokens"] for r in token_counts.quantiles(token_counts.count_tokens(empty), shares).collect()} == {None}


def test_bpe_fails_if_splits_change():
    """Places that were made of other rows than the words, or in another order."""
    import pyarrow as pa

    def read(texts):
        chunks = bpe.Chunk(1, 3, False), bpe.Chunk(1, 3, True)
        for chunk in chunks:
            for i, t in enumerate(texts):
                chunk.add(i, t)
        words, places = bpe._batch(chunks[0].word_rows(), bpe.WORDS), bpe._batch(chunks[1].place_rows(), bpe.PLACES)
        lists = [words.column(c).to_pylist() for c in ("chunk", "block", "bucket", "check", "sizes")]
        answers = bpe._batch([(*key, [1] * len(sizes), [7] * len(sizes)) for *key, sizes in zip(*lists)], bpe.ANSWERS)
        return pa.table(answers), pa.table(places)

    first, second, none = read(["a b", "c d e"]), read(["c d e", "a b"]), read([""])
    assert bpe.put_together(*first).column("n_tokens").to_pylist() == [2, 3]
    for answers, places in ((first[0], second[1]), (first[0], none[1]), (none[0], first[1])):
        with pytest.raises(RuntimeError, match="when read again"):
            bpe.put_together(answers, places)


def test_very_long_texts(spark):
    """A million characters of words, of one word and of numbers, beside short texts."""
    from tessera.llm import sharding, toxicity

    texts = [prose(8, 150_000), "x" * 1_000_000, "1 " * 500_000, "short text here", prose(8, 150_000), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert groups[4][:2] == (0, 2) and groups[1][:2] == (1, 1) and groups[0][2] == sha(texts[0])
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert near[4] == 0 and len(near) == 6
    prints = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert prints[0]["fingerprint"] == prints[4]["fingerprint"] and prints[1]["n_chars"] == 1_000_000
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 6
    out = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard_rows(docs, shards=3).collect()}
    assert out == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
