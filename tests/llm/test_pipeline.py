import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from patternlake.llm.common import table
from patternlake.llm.packing import piece_lengths
from test_linededup import plain as plain_lines
from test_quality import plain_counts
from test_simhash_similar import plain_representatives


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    columns = docs.columns
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(stage(spark, states[-1], sf_dir).cache())
    assert all(s.columns == columns for s in states[:-1])
    rows = [{r.doc_id: r.asDict() for r in s.collect()} for s in states[:-2]]
    raw, good, lined, unique = rows
    mixed = [r.asDict() for r in states[-2].collect()]
    # This scale has too few labels to certify cutoffs: the base rule decides.
    base = {i for i, r in raw.items() if (c := plain_counts(r["text"]))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert set(good) == base and all(good[i] == raw[i] for i in good)
    gone = plain_lines([(i, r["text"]) for i, r in good.items()], 8)
    want = {i: "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (False, i, n) not in gone) for i, r in good.items() if not all((False, i, n) in gone for n in range(len(r["text"].split("\n"))))}
    assert {i: r["text"] for i, r in lined.items()} == want and all(len(r["text"]) == r["n_chars"] for r in lined.values())
    kept, _ = plain_representatives([(i, r["text"]) for i, r in lined.items()])
    assert set(unique) == kept and all(unique[i] == lined[i] for i in unique)
    # Whole texts, or prefixes of the last epoch's; shares as the target weights have them.
    assert all(unique[r["doc_id"]]["text"].startswith(r["text"]) for r in mixed)
    tokens = Counter()
    for r in mixed:
        tokens["web" if re.fullmatch("src[0-9]", r["source"]) else "books" if re.fullmatch("src1[0-3]", r["source"]) else "news" if re.fullmatch("src1[4-6]", r["source"]) else "other"] += len(r["text"].split())
    supply = sum(len(r["text"].split()) for r in unique.values())
    assert abs(sum(tokens.values()) / supply - 1.5) < 0.02
    for domain, weight in {"web": 4, "books": 3, "news": 2, "other": 1}.items():
        assert abs(tokens[domain] / sum(tokens.values()) - weight / 10) < 0.02, tokens
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = Counter(), set()
    for p in states[-1].collect():
        assert zlib.crc32(p.ids) == p.ids_crc32 and p.length == len(p.ids) // 4
        pieces[p.doc_id, p.start, bytes(p.ids)] += 1
        sequences.add(p.sequence_id)
    want = Counter()
    for r in mixed:
        ids, at = tok.encode(r["text"], add_special_tokens=False).ids + [1], 0
        for n in piece_lengths(len(ids), 2048):
            want[r["doc_id"], at, b"".join(i.to_bytes(4, "little") for i in ids[at : at + n])] += 1
            at += n
    assert pieces == want and len(sequences) == sum(pieces.values())
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).drop("sequence_id").collect())) == sorted(map(str, states[-1].drop("sequence_id").collect()))
    spark.catalog.clearCache()  # other tests look at plans over the same files
