import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from netloom.llm.simhash import fingerprint
from tests.llm.test_mixing import targets_of
from tests.llm.test_quality import slow
from tests.llm.test_secrets import base as secret_spans
from tests.llm.test_secrets import slow_spans


def good(text):
    n, chars, symbols, dup, repeat = slow(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    capitals = sum(c.isupper() for c in text or "")
    top = max(map(words.count, set(words)), default=0)
    return n >= 50 and 2 * repeat <= n and 10 * symbols <= n and 10 * capitals <= 3 * chars and 2 * dup <= len(lines) and 2 * n <= chars <= 20 * n and 5 * top <= 2 * n


def survivors(docs):
    """The smallest id of each group of documents whose fingerprints are linked."""
    prints = {i: fingerprint(t) for i, t in docs.items()}
    left, kept = set(docs), set()
    while left:
        start = min(left)
        kept.add(start)
        todo = [start]
        left.discard(start)
        while todo:
            k = todo.pop()
            near = {j for j in left if (prints[j] ^ prints[k]).bit_count() <= 3}
            left -= near
            todo += near
    return kept


def test_stages_against_brute_force(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    made = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        made.append(docs)
    assert all(sorted(d.columns) == sorted(columns) for d in made[:-1])
    kept = {r.doc_id: r.text for r in made[0].collect()}
    assert kept == {i: t for i, t in texts.items() if good(t)}
    single = {r.doc_id: r.text for r in made[1].collect()}
    assert set(single) == survivors(kept)
    hidden = {r.doc_id: r for r in made[2].collect()}
    assert set(hidden) == set(single)
    assert all((r.text != single[i]) == bool(secret_spans(single[i])) or "[SECRET]" in r.text for i, r in hidden.items())
    assert not any(secret_spans(r.text) for r in hidden.values()) and all(r.n_chars == len(r.text) for r in hidden.values())
    mixed = [r for r in made[3].collect()]
    assert {r.text for r in mixed} <= {r.text for r in hidden.values()}
    assert max(sum(r.doc_id == i for r in mixed) for i in hidden) <= 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    pieces = made[4].collect()
    assert sum(p.length for p in pieces) == tokens and len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.token_ids)) for p in pieces)


def test_run_against_brute_force(spark, tiny):
    """The pieces of run() are those of the stages' documents, each stage done by hand but for the mix, whose
    sizes, targets and bounds are checked."""
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    kept = {i: r.text for i, r in texts.items() if good(r.text)}
    single = {i: kept[i] for i in survivors(kept)}
    hidden = {i: marked(t) for i, t in single.items()}
    size, taken = {i: len(t.split()) for i, t in hidden.items()}, Counter()
    pieces = {}
    for p in corpus_pipeline.run(spark, tiny).collect():
        pieces.setdefault((p.doc_id, p.start), []).append(p)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in hidden.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        copies = len(pieces.get((i, 0), []))
        taken[texts[i].source] += copies * size[i]
        assert copies <= 2
        start = 0
        while start < len(ids) and copies:
            found = pieces.pop((i, start))
            assert len(found) == copies and {tuple(p.token_ids) for p in found} == {tuple(ids[start : start + found[0].length])}
            start += found[0].length
        assert start == (len(ids) if copies else 0)
    assert not pieces
    sizes = Counter()
    for i in hidden:
        sizes[texts[i].source] += size[i]
    for source, target in targets_of(sizes).items():
        assert abs(taken[source] - target) <= max(size[i] for i in hidden if texts[i].source == source)


def marked(text):
    """The text with a mark in place of every span or run of overlapping spans."""
    out, at = "", 0
    for a, _, b in slow_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_columns_of_any_name_nulls_and_repeated_rows(spark, tmp_path):
    good_text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, good_text, "a", "orig", "mine", "f", 1), (1, good_text, "a", "orig", "mine", "f", 1), (2, None, "a", "k", "s", "f", 2), (3, "", None, "k", "s", "f", 3), (None, good_text + " token=abcdef12", None, "k", "s", "f", 4), (5, " ".join(f"other{k}" for k in range(90)) + " password: hunter22", None, "k", "s", "f", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, spans string, failed_rule string, size int")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.columns == columns
        if number == 0:
            assert sorted((r["size"] for r in docs.collect())) == [1, 1, 4, 5] and {r.kept for r in docs.collect()} == {"orig", "k"}
        if number == 1:
            single = docs.collect()
            assert len(single) in (2, 3) and {r.spans for r in single} <= {"mine", "s"}
        if number == 2:
            assert not any("hunter22" in r.text or "abcdef12" in r.text for r in docs.collect()) and docs.count() == len(single)
    assert corpus_pipeline.pack(spark, docs, "").count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
