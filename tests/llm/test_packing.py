import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomquery.llm import packing
from loomquery.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_tokenizers(slow):
    rng = random.Random(3)
    alphabet = [*" \n\t\r'’“”", *"abcXYZ0189.,;:!?-_#%&|<>", "é", "ß", "ñ", "中", "文", "あ", "Ж", "😀", "\u00a0", "\u2003", "\x0b", "\x85", "\u0301", "¼", "'s", "'ll", "<|endoftext|>", "  ", "\n\n"]
    encode = packing.Encoder(tokenizer_path())
    assert encode.fast
    for _ in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert encode(s).tolist() == slow.encode(s, add_special_tokens=False).ids, repr(s)


def test_balance_fills_every_sequence():
    rng = random.Random(1)
    for n in (0, 1, 7, 400):
        lengths = [rng.choice([1, 5, 300, 900, 2047, rng.randint(1, 2047)]) for _ in range(n)]
        pieces = packing.balance(lengths)
        held, per = {}, [0] * n
        for d, at, k, s in pieces:
            assert at == per[d] and k > 0
            per[d] += k
            held[s] = held.get(s, 0) + k
        assert per == lengths and all(x == 2048 or x & (x - 1) == 0 for x in held.values())
        assert sorted(held) == list(range(len(held)))
    cost = lambda ks: sum(packing.LINEAR * k + packing.QUADRATIC * k * k for k in ks)
    by = {}
    for _, _, k, s in packing.balance([512] * 40 + [64] * 320):
        by.setdefault(s, []).append(k)
    costs = [cost(ks) for ks in by.values()]
    assert max(costs) - min(costs) <= cost([512])


def test_round_trip(spark, trouble, empty, slow):
    docs = trouble.select("doc_id", "text", "size")
    got = packing.pack(docs, tokenizer_path()).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append(np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    tokens = sum(len(x) for xs in ids.values() for x in xs)
    assert sum(r["length"] for r in got) == tokens
    sequences = {}
    for r in got:
        ours = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ours)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_whole_table_equals_tokenizers(spark, sf, slow):
    """Every document of the table, and a few very long ones."""
    encode = packing.Encoder(tokenizer_path())
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    for t in [*texts, " ".join(texts)[:300_000], "a" * 100_000, " " * 50_000, "é中\n\n" * 20_000]:
        assert encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_assignment_matches_brute_force():
    """Each document in descending length to the cheapest sequence with room, else cut at the roomiest."""
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randint(1, 63) for _ in range(rng.randint(1, 40))]
        room = {s: 64 for s in range(sum(lengths) // 64)}
        rest = sum(lengths) % 64
        for b in (32, 16, 8, 4, 2, 1):
            if rest & b:
                room[len(room)] = b
        cost, want = dict.fromkeys(room, 0.0), []
        for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at = 0
            while at < lengths[d]:
                n = lengths[d] - at
                fits = [s for s in room if room[s] >= n]
                s = min(fits, key=lambda s: (cost[s], s)) if fits else max(room, key=lambda s: (room[s], -s))
                k = min(n, room[s])
                want.append((d, at, k, s))
                room[s] -= k
                cost[s] += packing.LINEAR * k + packing.QUADRATIC * k * k
                at += k
        assert packing.balance(lengths, 64) == want


def test_text_ids_stay(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string")
    got = packing.pack(docs, tokenizer_path())
    assert got.schema["doc_id"].dataType.simpleString() == "string" and {r["doc_id"] for r in got.collect()} == {"a", None}
