"""Token alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skirmish.llm import queries, token_alignment

from .conftest import SF, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(odd)}

    def spans(text):
        """(id, end) of both tokenizers over the whole text; none where bytes differ."""
        if not text:
            return [], []
        a, b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
        whole_a = [bytes(byte[c] for c in t) for t in a.tokens]
        whole_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(whole_a) != (" " + text).encode() or b"".join(whole_b) != (" " + text).encode():
            return [], []
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 3000 else __import__("numpy").cumsum([len(p) for p in parts]).tolist()
        return list(zip(a.ids, ends(whole_a), strict=True)), list(zip(b, ends(whole_b), strict=True))

    def whole(rows):
        both = [spans(t) for _, t in rows]
        links = []
        for a, b in both:
            at = {end: i for i, end in b}
            links.append([(i, at[end]) for i, end in a if end in at])
        counts = Counter(x for l in links for x in l)
        best = Counter()
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        out = []
        for (doc_id, _), (a, b), mine in zip(rows, both, links, strict=True):
            cuts = sorted({e for _, e in a} & {e for _, e in b})
            side, text = {}, []
            for name, tokens in (("a", a), ("b", b)):
                at, group = 0, []
                side[name] = []
                for i, end in tokens:
                    group.append(str(i))
                    if end == cuts[at]:
                        side[name].append(",".join(group))
                        at, group = at + 1, []
            text = ";".join(f"{x}|{y}" for x, y in zip(side["a"], side["b"], strict=True))
            digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
            out.append((doc_id, len(a), len(b), len(cuts), len(mine), sum(counts[x] == best[x[1]] for x in mine), sum(counts[x] for x in mine), digest))
        return sorted(out, key=repr)

    return whole


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_query_equals_whole_texts(spark, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_token_alignment(spark, SF)) == plain(docs)


ODD = ["a<s>b</s> x\x00y", "  two  spaces ", "tab\there\n\n x", "é́ ﬁ ™ ①", "\xa0x \u2003y", "don't (can't) [x]'s we'll", "<0x41> a", "12 345,6.7 a1b2 ²,½", "\r\n\r\nq\n", " ", "  ", "x ", "\n", "\n\nA\nB", "👩‍👩‍👧 中文字 text 中文,x",
       "has ▁ one", "a▁", "!\x1c x\x1c\n y", "<|endoftext|> a <|endoftext|>", "x\u3000\u3000y", "word.\nNext, word\n\nnext!\n  in"]


def test_odd_texts(spark, plain, odd_rows, monkeypatch):
    r = random.Random(6)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "é", ".", ",", "'s", "1", "_", "中", "\xa0", "\u2028", "\x1c", "🙂", "|", "-", "(", "²", "́"]
    made = ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(600)]
    rows = odd_rows + list(enumerate(ODD + made, 100))
    frame = table(spark, rows)
    want = plain(rows)
    digest = lambda df: df.withColumn("groups_sha256", token_alignment.F.when(df.groups == "", "").otherwise(token_alignment.F.sha2("groups", 256)))
    assert got(digest(token_alignment.align(frame, A, B))) == want
    monkeypatch.setattr(token_alignment, "SAMPLED", 1)
    monkeypatch.setattr(token_alignment, "PAIRS", 0)
    assert got(digest(token_alignment.align(frame, A, B))) == want


def test_no_rows(spark, nothing):
    assert token_alignment.align(nothing, A, B).count() == 0


def test_words_only_where_each_space_may_be_cut():
    words = token_alignment.Cutter(["ab"]).words
    assert words("a b.\nC d") == ["a", "b.\nC", "d"]
    assert [words(t) for t in ("a  b", " a", "a ", "a\n b", "a \tb", "a\xa0 b", "a \x1c")] == [None] * 7


def test_cutter_keeps_pairs_of_a_piece_together():
    split = token_alignment.Cutter(["ab", "e.", "▁a"]).split
    assert split(" e.x a, b") == [" e.x", " a", ",", " b"]
    assert token_alignment.Cutter(["x▁y", "a\nb"]).split("x y\nz") == ["x y\nz"]


class Counted:
    """A tokenizer that counts the calls of ``normalize``."""

    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def normalize(self, text):
        self.calls += 1
        return self.inner.normalize(text)


def test_texts_are_not_normalized_where_the_model_has_no_rules():
    both = token_alignment.Tokenizers(A, B)
    r, bits = random.Random(3), ["a", " ", "  ", "\n", "▁", "é", "e\u0301", "\xa0", "ﬁ", "\x00", "<s>", "🙂", "Ⅷ", "\u3000", "\t"]
    texts = ODD + ["".join(r.choice(bits) for _ in range(r.randrange(1, 20))) for _ in range(500)]
    want = ["▁" not in t and both.second.normalize(t) == "▁" + t.replace(" ", "▁") for t in texts]
    both.second = Counted(both.second)
    assert [both.exact(t) for t in texts] == want and both.second.calls == 0
    both.as_is = False
    assert [both.exact(t) for t in texts] == want and both.second.calls > 0


def test_words_without_marks_are_not_searched_for_cuts():
    cutter = token_alignment.Cutter(["ab"])
    words = ["ab", "Übung", "中文", "a1", "a,b", "x_", "don't", "²", "e\u0301", "a\nb", "-"]
    want, split, asked = [cutter.split(" " + w) for w in words], cutter.split, []
    cutter.split = lambda t: asked.append(t) or split(t)
    assert [cutter.parts(w) for w in words] == want
    assert asked == [" " + w for w in words[3:]]


def test_units_are_encoded_to_flat_lists():
    both = token_alignment.Tokenizers(A, B)
    units = [" the", ",", " anatnd", "\n", " é́🙂", " <|endoftext|>", " 12"]
    got = [x.to_pylist() for x in both.encode(token_alignment.pa.array(units))]
    first = [both.first.encode(u, add_special_tokens=False).ids for u in units]
    second = [both.second.encode("\n" + u)[len(both.line) :] for u in units]
    assert got[0] == first and got[2] == second
    for u, *long in zip(units, got[1], got[3], strict=True):
        assert [sum(x) for x in long] == [len(u.encode())] * 2
    both.bytes[1][0][second[0][0]] = b"?"
    with pytest.raises(ValueError, match="do not give it back"):
        both.encode(token_alignment.pa.array(units))
