import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemill.llm import token_counts, token_files
from sievemill.llm.token_counts import Transducer, count_tokens
from sievemill.llm.token_files import ChunkEncoder, encoded_digest, read_token_files, write_token_files

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> <|startoftext|>x", "<s></s><unk><0x0A>", "漢字 😀 é́é İi ŉ", "don't, we'll... \x1c\x85\xa0x", "▁a ▁▁ b▁", "\0nul\0", "A,B.C ,. a., word, WORD. x" * 30, "y" * 5000, "word " * 4000, " " * 300 + "a"]
TEXTS = [*ODD, *["".join(random.Random(i).choice("abe th ion ▁é漢\n.,<'>s2") for _ in range(200)) for i in range(150)]]


def test_transducer_equals_library():
    t = Transducer(P.path("piece_bpe_32k.model"))
    for size in (1 << 16, 50, 3, 1):
        assert [t.count(x, size) for x in TEXTS] == [len(t.library.encode(x)) for x in TEXTS]


def test_state_maps_compose_associatively():
    t = Transducer(P.path("piece_bpe_32k.model"))
    text = t.escaped("the quick  brown fox jumps" * 5 + "漢字かな交じり文" * 30 + "aaaaaaaa" * 40)
    maps = [t.state_map(text[i : i + 7]) for i in range(0, len(text), 7)]
    whole = t.scan([text])
    for cut in range(1, len(maps)):
        one, two = t.combined(maps[:cut]), t.combined(maps[cut:])
        assert t.apply(t.compose(one, two), token_counts._START)[1] == whole
    a, b, c = maps[:3]
    assert t.compose(t.compose(a, b), c) == t.compose(a, t.compose(b, c))


def test_state_maps_hold_counts_of_texts_without_spaces():
    t = Transducer(P.path("piece_bpe_32k.model"))
    text = "".join(random.Random(3).choices("的一是不了人我在有他这中大来上国个到说们", k=20_000))
    maps = [t.state_map(text[i : i + 4096]) for i in range(0, len(text), 4096)]
    assert all(m.ahead + m.count > 2000 for m in maps)
    assert t.count(text, 4096) == len(t.library.encode(text))


def test_long_texts_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 1000)
    monkeypatch.setattr(token_counts, "CHUNK", 300)
    r = random.Random(5)
    texts = ["".join(r.choices("ab  的一é😀\n", k=n)) for n in (400, 999, 1000, 1001, 5000, 9000)] + [" " * 3000, "的" * 4000, "x" * 2500]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    library = Transducer(P.path("piece_bpe_32k.model")).library
    got = count_tokens(docs, P.path("piece_bpe_32k.model")).collect()
    assert sorted((x.n_bytes, x.n_tokens) for x in got) == sorted((len(t.encode()), len(library.encode(t))) for t in texts)


def library_ids(encoder, texts):
    return [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def encoded(encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    cuts = np.append(0, np.cumsum(sizes)).tolist()
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def test_chunks_encode_as_the_whole_text(monkeypatch):
    encoder = ChunkEncoder(P.path("word_bpe_49k.json"))
    assert encoded(encoder, TEXTS) == library_ids(encoder, TEXTS)
    monkeypatch.setattr(token_files, "REMEMBERED", 10)
    assert encoded(encoder, TEXTS) == library_ids(encoder, TEXTS) == encoded(encoder, TEXTS)
    assert encoded(encoder, [None, ""]) == [[], []] and encoded(encoder, []) == []
    whole = ChunkEncoder(P.path("byte_bpe_50k.json"), whole=True)
    assert encoded(whole, ODD) == [whole.library.encode(x, add_special_tokens=False).ids for x in ODD]


def test_letters_marks_and_stops_encode_as_the_library_does():
    r, signs = random.Random(4), [chr(c) for c in range(0x20, 0x2000)]
    letters, marks = ([c for c in signs if unicodedata.category(c)[0] == k] for k in "LM")
    plain = list("abcXYZ THE,.;:!?)('|<>-_ \n\t019#")
    turn = lambda u: r.choice(plain if u < 0.55 else letters if u < 0.85 else marks if u < 0.92 else [" ", ".", ","])
    texts = ["".join(turn(r.random()) for _ in range(r.randint(1, 25))) for _ in range(20_000)]
    texts += ["SAYIN VALİ, geldi.", "BELEDİYESİ. Ankara", "ड़, x", "क़. ड़,", "<|ENDOFTEXT|> a<|endoftext|>, H\u0331, H\u0331 IT'S, \u212b, ÅÄ,."]
    encoder = ChunkEncoder(P.path("word_bpe_49k.json"))
    assert encoded(encoder, texts) == library_ids(encoder, texts)


def test_a_text_of_ten_megabytes(spark):
    words = ["the", "Straße,", "漢字", "x1.", "\n"]
    text = " ".join(random.Random(1).choices(words, k=1_900_000))
    encoder = ChunkEncoder(P.path("word_bpe_49k.json"))
    want = [i for e in library_ids(encoder, [text]) for i in e]
    docs = spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in encoded_digest(docs, P.path("word_bpe_49k.json"), 2).collect()}
    assert got[1].n_tokens == len(want) + 1 and got[1].ids_crc32 == zlib.crc32(np.array([*want, 2], "<u4").tobytes())
    assert got[2].start == len(want) + 1


def test_files_follow_each_other_by_number(spark):
    files = spark.range(100_001).select(F.format_string("part-%05d-x-c000.zstd.parquet", "id").alias("file"), F.col("id").alias("all"))
    files = files.unionByName(spark.createDataFrame([("part-00007-x-c001.zstd.parquet", 5)], "file string, all long"))
    got = {r.file: r.base for r in token_files.file_bases(files).where("file like 'part-0000%' or file like 'part-100000%'").collect()}
    assert got["part-00007-x-c001.zstd.parquet"] == 28 and got["part-00008-x-c000.zstd.parquet"] == 33
    assert got["part-100000-x-c000.zstd.parquet"] == sum(range(100_000)) + 5


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files_round_trip(spark, tmp_path, encoding):
    rows = [(7, "b"), (None, "null id"), (3, None), (3, "again"), (3, "again"), *((100 + i, t) for i, t in enumerate(TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("file", F.lit(1))
    got = encoded_digest(docs, P.path("word_bpe_49k.json"), 2, encoding=encoding).collect()
    library = ChunkEncoder(P.path("word_bpe_49k.json")).library
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:]))
    by_id = {i: t for i, t in rows if i not in (3, None)}
    for r in got:
        if r.doc_id in by_id:
            ids = [*library.encode(by_id[r.doc_id], add_special_tokens=False).ids, 2]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_token_files_read_columns_and_ranges(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.lit("en").alias("lang"))
    write_token_files(docs, str(tmp_path / "t"), P.path("word_bpe_49k.json"), 2, meta=["lang"])
    part = read_token_files(spark, str(tmp_path / "t"), ["doc_id", "meta_lang"]).where("doc_id between 10 and 19")
    assert part.count() == 10
    plan = part._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema:")[-1].split("\n")[0] and "PushedFilters: [IsNotNull(doc_id)" in plan
    assert read_token_files(spark, str(tmp_path / "t")).columns == ["doc_id", "meta_lang", "n_tokens", "ids"]
    with pytest.raises(ValueError):
        write_token_files(docs, str(tmp_path / "u"), "", encoding="other")


def test_counts_of_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, "x"), (None, "a b"), (2, "word " * 5000)], "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in count_tokens(docs, P.path("piece_bpe_32k.model")).collect()}
    assert got[1, 0] == (0, False) and got[None, 3] == (2, False) and got[2, 25000][1]
    assert count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).collect() == []


def test_models_that_cross_words_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(P.path("piece_bpe_32k.model"), "rb").read())
    model.pieces[500].piece = "a▁b"
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        Transducer(str(tmp_path / "m"))
