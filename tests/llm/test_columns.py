"""Columns of any name go through every operator that returns a table's rows."""

import pyarrow as pa
import pytest

import corpus_pipeline
from skein.llm import decontaminate, external_shuffle, langid_unigram, log_templates, mixing_tree, quality_pu, simhash_golay
from skein.llm.common import table

ODD = {"a.b": 1, "A.B": 2, "q`uoted": 3, "TEXT": 4, "shard": 5, "Slot": 6, "_a": 7, "part": 8}


def odd_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(80)
    rows = [tuple(r) for r in docs.collect()] + [(None, None, None, None, None), (5, "", "en", None, 0), (5, None, "en", "s", 0)]
    rows += [(1000, "Twice the very same row, with words.", "en", "web", 36)] * 2 + [(1001, "long " * 60_000, "en", "web", 300_000)]
    extra = ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    return spark.createDataFrame([(*r, *map(str, ODD.values())) for r in rows], schema)


OPERATORS = {
    "keep_one": lambda s, d, f: simhash_golay.keep_one(d),
    "shard": lambda s, d, f: external_shuffle.shard(d, 5),
    "mix": lambda s, d, f: mixing_tree.mix(d, 4),
    "drop_recurring_lines": lambda s, d, f: log_templates.drop_recurring_lines(d),
    "decontaminated": lambda s, d, f: decontaminate.decontaminated(d, table(s, f, "benchmark")),
    "accepted": lambda s, d, f: quality_pu.accepted(d, table(s, f, "labels")),
    **{f"stage {name}": stage for name, stage in corpus_pipeline.STAGES},
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_of_any_name(spark, sf_dir, name):
    docs = odd_table(spark, sf_dir)
    out = OPERATORS[name](spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns
    if name.startswith("stage") and name != "stage shard":
        assert out.columns == docs.columns
    plain = out.toDF(*[f"c{k}" for k in range(len(out.columns))]).collect()
    assert plain and all(r[5:13] == tuple(map(str, ODD.values())) for r in plain)


def test_numerals_are_no_letters(spark):
    texts = ["½ ² 12", "٣ ④ Ⅷ _", "", None, "a", "é", "中"]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(k, f"the words of {k}", "en", "s", 1) for k in range(10, 40)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.lang_pred for r in langid_unigram.predictions(docs).collect()}
    assert [out[k] == "und" for k in range(7)] == [not any(map(str.isalpha, t or "")) for t in texts]


def test_single_white_space_texts_keep_their_id():
    import public_tokenizers
    from tokenizers import Tokenizer

    from skein.llm.token_repair import WordEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += [a + b for a in " \n\t\xa0 " for b in ("", "x", " ", "\xa0", ".", "\n")]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert [list(x) for x in WordEncoder(path).encode(pa.array(texts))] == want
