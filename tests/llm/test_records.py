"""WARC archives, PNG columns and shards."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import media, sharding, warc


def test_archives_equal_brute_force(spark):
    r = random.Random(5)
    bodies = ["", None, "<p>a</p>", "é" * 500, "x\r\n\r\ny", *["b%d" % i for i in range(30)]]
    rows = [(i, r.choice(["http://a/b c", None, "http://ä/\r\nX: y"]), "hot" if i % 3 == 0 else r.choice(bodies)) for i in range(200)]
    rows += [(None, "u", "hot"), (7, "u", "hot"), (9, rows[9][1], rows[9][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))
    for least in (0, 10):
        first = {}
        for i, _, b in rows:
            if i is not None:
                first[b or ""] = min(i, first.get(b or "", i))
        want = Counter()
        for i, _, b in rows:
            raw = (b or "").encode()
            again = i is not None and len(raw) >= least and i > first[b or ""]
            want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[b or ""] if again else None] += 1
        got = warc.round_trip(pages, least=least)
        assert Counter(tuple(x)[:5] for x in got.collect()) == want
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_records_are_whole_and_checked():
    one, two = warc.response_record(1, "http://a", b"body", "2000-01-01T00:00:00Z"), warc.revisit_record(2, None, "D" * 32, 4, 1, "http://a", "2000-01-01T00:00:00Z")
    packed = gzip.compress(one) + gzip.compress(two)
    assert list(warc.members(io.BytesIO(packed), 7)) == [one, two]
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(packed[:-9]), 7))
    fields, block = warc.parse_record(one)
    assert block.endswith(b"\r\n\r\nbody") and fields["warc-refers-to" if "warc-refers-to" in fields else "warc-type"] == "response"
    assert warc.parse_record(two)[0]["warc-refers-to"] == fields["warc-record-id"] or fields["warc-payload-digest"] != "sha1:" + "D" * 32
    with pytest.raises(ValueError):
        warc.parse_record(one + b"x")


def _filtered(pixels, kind):
    """An independent encoder for one row filter."""
    h, w, c = pixels.shape
    rows = pixels.reshape(h, w * c).astype(int)
    out = b""
    for y in range(h):
        line = []
        for x in range(w * c):
            a = rows[y, x - c] if x >= c else 0
            b = rows[y - 1, x] if y else 0
            d = rows[y - 1, x - c] if y and x >= c else 0
            p = a + b - d
            near = min((abs(p - v), i) for i, v in enumerate((a, b, d)))[1]
            guess = [0, a, b, (a + b) // 2, (a, b, d)[near]][kind]
            line.append((rows[y, x] - guess) % 256)
        out += bytes([kind, *line])
    return out


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_decodes_all_filters(channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (9, 7, channels), dtype=np.uint8)
    for kinds in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2), (0, 1, 2, 3, 4)):
        assert (media.decode_png(media.encode_png(pixels, kinds=kinds)) == pixels).all()
    for kind in range(5):
        assert b"".join(bytes([kind, *row]) for row in media._filtered(pixels.reshape(9, -1), channels, kind).tolist()) == _filtered(pixels, kind)
    made = media.encode_png(pixels)
    for kind in range(5):
        body = zlib.compress(_filtered(pixels, kind))
        data = made[: 8 + 25] + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", body[:20]) + media._chunk(b"IDAT", body[20:]) + media._chunk(b"IEND", b"")
        assert (media.decode_png(data) == pixels).all()


def test_damaged_png_is_refused():
    good = media.encode_png(media.text_pixels(b"hello" * 100))
    assert media.decode_png(good).tobytes().rstrip() == b"hello" * 100
    for bad in (b"", b"x" + good[1:], good[:40], good[:-12], good[:50] + b"!" + good[51:], good.replace(b"IHDR", b"IHDX"), good[:8] + media._chunk(b"IHDR", b"short") + good[33:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_cosine_hash_follows_the_picture():
    blocks = np.random.default_rng(3).integers(40, 215, (8, 8), dtype=np.uint8)
    one = np.repeat(np.kron(blocks, np.ones((12, 8), np.uint8))[:, :, None], 3, 2)
    near = np.clip(one.astype(int) + np.random.default_rng(1).integers(-4, 5, one.shape), 0, 255).astype(np.uint8)
    other = one[::-1, ::-1].copy()
    bits = lambda a, b: sum((p ^ q).bit_count() for p, q in zip(media.cosine_hash(a), media.cosine_hash(b)))
    assert bits(one, near) <= 12 < bits(one, other)


def test_cosine_hash_equals_plain_sums():
    pixels = np.random.default_rng(5).integers(0, 256, (64, 96, 3), dtype=np.uint8)
    small = pixels.mean(axis=2).reshape(32, 2, 32, 3).mean(axis=(1, 3))
    wave = lambda u, i: np.cos(np.pi * u * (2 * i + 1) / 64)
    low = [sum(small[y, x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    assert np.unpackbits(np.frombuffer(media.cosine_hash(pixels), np.uint8)).tolist() == [int(round(z, 6) > round(middle, 6)) for z in low]


def test_rows_of_the_query_are_filtered(spark):
    data = media.media_column(spark.createDataFrame([(1, "some words of a text " * 900)], "doc_id long, text string")).first().media
    raw = zlib.decompress(data[41 : 41 + int.from_bytes(data[33:37])])
    assert len({raw[i] for i in range(0, len(raw), 193)} - {0}) >= 1


def test_media_of_ten_megabytes(spark):
    text = "lorem ipsum é " * 700_000
    got = media.media_features(media.media_column(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    payload = text.encode()
    assert got.payload_sha256 == hashlib.sha256(payload.ljust(-(-len(payload) // 192) * 192)).hexdigest()


def test_media_rows(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "é" * 1000), (4, "é" * 1000), (None, "x" * 192)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = media.media_features(media.media_column(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        payload = text.encode().ljust(max(1, -(-len(text.encode()) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and len(r.phash) == 8
    assert len({(r.media_sha256, r.phash) for r in got if r.doc_id == 4}) == 1
    assert media.media_features(media.media_column(docs.limit(0))).collect() == []


def test_shards_are_even_whole_and_repeatable(spark):
    rows = [(i, f"text {i} é") for i in range(1003)] + [(None, "n"), (None, None), (5, "text 5 é"), (5, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = sharding.shard_digest(docs, 40, bucket_bytes=2000).collect()
    two = sharding.shard_digest(docs.repartition(7), 40, bucket_bytes=2000).collect()
    assert Counter(one) == Counter(two)
    sizes = Counter(r.shard for r in one)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in one if r.shard == s) == list(range(sizes[s]))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in one) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    order = [r.doc_id for r in sorted(one, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.15
    assert sharding.shard_digest(docs.limit(0), 40).collect() == []
    with pytest.raises(ValueError):
        sharding.shuffle_to_shards(docs.withColumn("__slot", F.lit(1)))


def test_one_id_and_one_row_may_be_most_of_the_table(spark):
    rows = [(7, f"text {i}", None) for i in range(2000)] + [(8, "same", {"k": 1})] * 2000 + [(i, "x" * 5000, {"k": i}) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    per = sharding.scattered(docs, 50, 4, 20).where("doc_id = 7").groupBy("__bucket").count().collect()
    assert len(per) == 50 and max(r["count"] for r in per) < 80
    path = sharding.shuffle_to_shards(docs, 10, bucket_bytes=4000)
    got = sharding.read_shards(docs, path).collect()
    assert Counter((r.doc_id, r.text, str(r.more)) for r in got) == Counter((i, t, str(m)) for i, t, m in rows)
    assert Counter(r["__shard"] for r in got) == {s: 405 for s in range(10)}
    assert all(sorted(r["__slot"] for r in got if r["__shard"] == s) == list(range(405)) for s in range(10))
    again = sharding.read_shards(docs, sharding.shuffle_to_shards(docs.repartition(3), 10, bucket_bytes=4000)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_permutation_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(4, 1, b)) for b in range(4800))
    assert len(seen) == 24 and min(seen.values()) > 130
