from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helixframe.llm import credentials, decontamination, toxicity

from .test_near_duplicates import groups, plain_print

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(llm, tmp_path):
    """Each stage against a plain version on its own input."""
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        path = str(tmp_path / str(k))
        stage(llm, docs, FOLDER).write.parquet(path)
        docs = llm.read.parquet(path)
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name == "toxicity":
            labels = llm.read.parquet(f"{FOLDER}/labels.parquet")
            rows = llm.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
            assert ids == {r.doc_id for r in toxicity.toxicity(rows, labels).filter("predicted = 0").collect()}
        elif name == "near_duplicates":
            prints = {r.doc_id: plain_print(r.text) for r in before}
            member = groups(list(prints.values()))
            assert ids == {min(i for i, p in prints.items() if p in g) for g in set(member.values())} and len(after) == len(ids)
        elif name == "decontamination":
            items = [r.text.lower().split() for r in llm.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            for r in before:
                words = " ".join(r.text.lower().split())
                if any(" ".join(w) in words for w in items):
                    assert r.doc_id not in ids
            assert len(before) - len(after) < 0.2 * len(before)
        elif name == "secrets":
            assert [r.doc_id for r in sorted(before)] == [r.doc_id for r in sorted(after)]
            assert credentials.scan(docs).filter("n_live > 0").count() == 0
        else:
            whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            pieces = defaultdict(list)
            for r in after:
                pieces[r.doc_id].append((r.start, bytes(r.token_ids)))
            assert set(pieces) == {r.doc_id for r in before}
            for r in before[:60]:
                want = np.array(whole.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes()
                assert b"".join(b for _, b in sorted(pieces[r.doc_id])) == want
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_reads_the_folder(llm):
    assert corpus_pipeline.run(llm, FOLDER).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and decontamination is not None
