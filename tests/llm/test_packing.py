import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skirmish.llm import packing
from skirmish.llm.queries import QUERIES
from tests.llm.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole():
    return Tokenizer.from_file(PATH)


def holds(pieces, ids, length=4096):
    """Every id lies in one piece, sequences are gapless and short enough; returns the share of padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p), sequences[p.sequence_id].append(p)
    assert docs.keys() == ids.keys()
    for name, own in docs.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[name])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[name][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[name])
    padded = total = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        padded += 0 if at & (at - 1) == 0 else length - at
        total += at
    return padded / max(1, total)


def test_query_round_trip(spark):
    t = whole()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows}
    assert holds(QUERIES["op10_packing"](spark, SF).collect(), ids) < 0.01


def test_words_encode_as_the_whole_text():
    cache, t, r = packing.WordCache(PATH), whole(), random.Random(2)
    letters = list("abcXYZ019 .,!?'\"-_<>|/\n\t\x0b\x1c\x1f\x85\xa0 　éÉßñÿµªº·×÷İıſKﬁ漢字がカ한🙂👧́​‍﻿\x00") + ["<|endoftext|>", "<s>", "don't", "I'LL"]
    for _ in range(5000):
        x = "".join(r.choice(letters) for _ in range(r.randint(1, 14)))
        assert np.frombuffer(cache.encode(x)[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_cuts_are_cheapest():
    r = random.Random(1)

    def cost_of(cuts, places, penalties, length):
        total, before = 0, 0
        for c in cuts:
            size = places[c] - before
            total += penalties[c] + (0 if size & (size - 1) == 0 else length - size)
            before = places[c]
        return total

    for _ in range(60):
        length = r.choice([8, 16])
        places = np.unique([0, *np.cumsum([r.randint(1, 6) for _ in range(12)])])
        penalties = np.array([r.choice([0, 1, 4]) for _ in places])
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                if (size := places[j] - places[i]) <= length:
                    best[j] = min(best[j], best[i] + penalties[j] + (0 if size & (size - 1) == 0 else length - size))
        cuts = packing.cut_positions(places, penalties, length, True)
        assert cuts[-1] == len(places) - 1 and cost_of(cuts, places, penalties, length) == best[-1]


def test_odd_rows(spark, odd, odd_rows, nothing):
    t = whole()
    texts = {i: x for i, x in odd_rows if i != 9}
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in texts.items()}
    unique = odd.where("doc_id is null or doc_id <> 9").dropDuplicates(["doc_id", "text"])
    holds(packing.pack(unique, PATH).collect(), ids)
    assert packing.pack(odd, PATH).where("start = 0").count() == len(odd_rows)
    assert packing.pack(nothing, PATH).count() == 0
