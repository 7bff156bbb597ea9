import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from drayline.llm import alignment as al
from drayline.llm import query_alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Brute:
    """Whole texts by the libraries; links byte by byte."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        codes = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173]
        self.chars = {chr(b): b for b in codes} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in codes)}

    def tokens(self, text):
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        a = [(i, bytes(self.chars[c] for c in self.a.id_to_token(i))) for i in a]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()) for i in b for p in [self.b.id_to_piece(i)]]
        whole = f" {text}".encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def aligned(self, text):
        a, b = self.tokens(text) if text else ([], [])
        owner_a = [k for k, (_, raw) in enumerate(a) for _ in raw]
        owner_b = [k for k, (_, raw) in enumerate(b) for _ in raw]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, left, right = [], [], []
        for at, (i, j) in enumerate(zip(owner_a, owner_b, strict=True)):
            ends = [at + 1 == len(own) or own[at + 1] != own[at] for own in (owner_a, owner_b)]
            left += [a[i][0]] * ends[0]
            right += [b[j][0]] * ends[1]
            if all(ends):
                groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
                left, right = [], []
        return len(a), len(b), ";".join(groups), len(groups), [(a[i][0], b[j][0]) for i, j in links]

    def corpus(self, docs):
        found = [(d, *self.aligned(t)) for d, t in docs]
        counts = Counter(p for *_, links in found for p in set(links))
        most = Counter()
        for (a, _), n in counts.items():
            most[a] = max(most[a], n)
        return sorted(
            (
                (d, n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
                 hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                for d, n_a, n_b, groups, n_groups, links in found
            ),
            key=str,
        )


ODD = ["a\n b \x1c c\u3000 d\xa0 e", "  two  blanks   at ends  ", " ", "  ", "x", "tab\t then", "<s> </s> <|endoftext|> <0x41>", "nul\0 in it",
       "mark \u2581 of blanks", "\u2581", "don't we'll I'M 123,456.78 \u6f22\u5b57\u4eee\u540d \U0001f600\U0001f468\u200d\U0001f469", "a" * 3000, "\u6f22" * 500,
       "e\u0301 \u05e9\u05dc\u05d5\u05dd \u0645\u0631\u062d\u0628\u0627", "\n\n \n", " \n ", "a \n", "line\r\nnext  \r\n last "]


@pytest.fixture(scope="module")
def brute():
    return Brute()


@pytest.mark.parametrize("options", [al.AlignOptions(), al.AlignOptions(remembered=1000, longest=4, broadcast_pairs=0, salts=3)])
def test_odd_texts(spark, brute, odd_documents, options):
    extra = spark.createDataFrame([(50 + i, t) for i, t in enumerate([*ODD, *ODD[:3]])], "doc_id long, text string")
    docs = odd_documents.unionByName(extra, allowMissingColumns=True).withColumnRenamed("score", "pairs")
    found = al.with_alignment(docs, options, digest=True)
    assert set(docs.columns) - set(found.columns) == {"text", "pairs"}
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=str) == brute.corpus([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_query(spark, brute):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = query_alignment.op11_alignment(spark, sf_dir)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == brute.corpus(docs)


def test_groups_and_pairs(spark, brute, no_documents):
    docs = spark.createDataFrame([(1, "tokenizers unlike in their splits"), (2, None)], "doc_id long, text string")
    one, two = al.with_alignment(docs).orderBy("doc_id").collect()
    _, _, groups, _, links = brute.aligned("tokenizers unlike in their splits")
    assert one["groups"] == groups and two["groups"] == "" and two["pairs"] == []
    assert dict(zip(one["pairs"], one["times"], strict=True)) == Counter(a << 32 | b for a, b in links)
    assert al.with_alignment(no_documents).collect() == []
