"""Text kernels over cuts of a batch, and names that operators use themselves."""

import numpy as np
import pyarrow as pa
import pytest
from lociq.llm import block_names, host_rules, merkle, packing, repeats, set_join, sharding, text


def test_a_text_longer_than_a_run_stays_whole():
    words = " ".join(f"w{i % 97}" for i in range(3000))
    rows = ["a b c d e f", None, words, "", words + " end", "x y", "É é " * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["key", "text"])
    whole = [text.shingle_sets(data, offs, 4) for _, data, offs in text.pieces(iter([batch]), most=1 << 30)]
    assert len(whole) == 1
    for most in (1, 10, 5000):
        seen, keys = [], []
        for part, data, offs in text.pieces(iter([batch]), most=most):
            values, at = text.shingle_sets(data, offs, 4)
            seen += [values[at[i] : at[i + 1]] for i in range(part.num_rows)]
            keys += part.column("key").to_pylist()
        values, at = whole[0]
        assert keys == list(range(len(rows))) and all(np.array_equal(x, values[at[i] : at[i + 1]]) for i, x in enumerate(seen))


@pytest.fixture(scope="module")
def named(spark):
    """Columns that bear the operators' own names."""
    own = ["_rest", "_void", "_id", "_sha", "_n", "host", "spans", "id_text", "_at", "rank", "shard", "leaf", "key", "row", "name"]
    filler = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(i, f"{filler} {i // 2 * 2} {'again ' * (i % 2)}", "s", "en", 9, *[f"{c}{i}" for c in own]) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in own)).repartition(2)


def test_names_of_columns_do_not_clash(named):
    for found in (host_rules.drop_rejected(named), block_names.drop_copies(named), set_join.drop_near_copies(named), repeats.cut_repeats(named, length=60)):
        assert found.columns == named.columns and found.count() == found.select("doc_id").distinct().count() > 0
    assert {r.doc_id for r in packing.pack(named).collect()} == set(range(12))
    assert merkle.audit(named).count() == sharding.shard_slots(named).count() == host_rules.quality_rules(named).count() == block_names.exact_groups(named).count() == 12
