import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vecatlas.llm.packing import cuts, pack, unpack_ids, write_buckets

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [None, "", "   ", "One two.", "É\u0301a b\u00a0c\x1cd <|endoftext|> 's it's X'RE\tİstanbul ΣΑΣ \u2003end", "word " * 5000, "thé " * 2047, "One two.", "ªº µm ¼½ x²y 3½% \u00adsoft Ÿ ŉ ǅ ǆe ß ẞ fi ﬁ İx e\u0301 <|startofTEXT|>a'LL\u0085b ƒ_~€¤§ Ñandú's ÀÉ!!"]


def test_cuts():
    assert cuts(5000) == [2048, 2048, 512, 256, 128, 8]
    assert cuts(2048) == [2048]
    assert cuts(1) == [1]


def test_pieces_equal_direct_encoding(spark):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(None, "a null id", 7, "x")], "doc_id long, text string, start int, ids string")
    rows = pack(docs, PATH).collect()
    direct = Tokenizer.from_file(PATH)
    want = {i: direct.encode(t or "", add_special_tokens=False).ids + [1] for i, t in [*enumerate(TEXTS), (None, "a null id")]}
    for i, ids in want.items():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in mine for x in unpack_ids(r["ids"])] == ids
        assert [r["length"] for r in mine] == cuts(len(ids))
        assert all(r["doc_tokens"] == len(ids) and r["offset"] == 0 for r in mine)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert zlib.crc32(np.array(want[3], dtype="<u4").tobytes()) == zlib.crc32(b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == 3), key=lambda r: r["start"])))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_buckets_hold_equal_lengths_and_every_piece(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, "One two."), (3, "another text with this id")], "doc_id long, text string")
    pieces = pack(docs, PATH)
    write_buckets(pieces, f"{tmp_path}/buckets")
    stored = spark.read.parquet(f"{tmp_path}/buckets").collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in stored) == sorted((r["doc_id"], r["start"], r["length"]) for r in pieces.collect())
    assert all(len(unpack_ids(r["ids"])) == r["length"] for r in stored)
    assert all(2 ** r["bucket"] == r["length"] for r in pieces.collect())
