"""The packing encoder against tokenizers on texts with added tokens."""

import random
import zlib

import numpy as np
import public_tokenizers
import tokenizers

from factloom.llm import packing

END = "<|endoftext|>"
TEXTS = ["a b <|endoftext|> c", END, END + END, f" {END} ", f"x{END}y  {END}\n z", f"<|endoftext{END}|>", "<|END|> <|endoftext |>", f"é 漢字 {END}\t{END}ŝ  w ", "no token  here"]


def test_added_tokens_as_tokenizers_finds_them(spark):
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng = packing.text_encoder(packing.vocabulary_path()), random.Random(2)
    texts = TEXTS + ["".join(rng.choice([END, " ", "  ", "\n", "word", " two", "<|", "|>", "é", "'s", "12"]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    rows = packing.pack_documents(spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")).collect()
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array([64, 275, 220, 50256, 269, 2], "<u4").tobytes())]
