"""Work of the salvage reader and of the chat formatter grows in proportion to what they read."""

import gzip
import hashlib
import time

from pyspark.sql import functions as F

from recallgrid.llm import chat, warc


def test_salvage_of_many_damaged_members():
    """16 MB of members with a fault in each."""
    member = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", mtime=0)
    broken = bytearray(member)
    broken[len(broken) // 2] ^= 0xFF
    data = bytes(broken) * ((16 << 20) // len(broken)) + member
    began = time.time()
    found = list(warc.salvage(data))
    assert time.time() - began < 60
    assert found[-1][0] == "record" and found[-2] == ("gap", (0, len(data) - len(member), found[-2][1][2]))


def test_many_turns(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat.text_part(F.concat(F.lit("é<|end|> "), F.col("id").cast("string"))).alias("parts"))
    began = time.time()
    (got,) = chat.digest(chat.format_chats(rows)).collect()
    assert time.time() - began < 60
    texts = [f"é<|end|> {i}" for i in range(n)]
    loss = "".join(texts[1::2])
    said = "".join(f"{'assistant' if i % 2 else 'user'}\n{t}\n" for i, t in enumerate(texts))
    assert got["n_turns"] == n and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digest(chat.format_chats(rows.filter("false"))).collect() == []
