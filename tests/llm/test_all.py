"""Every query on odd and on empty tables: it returns a row for each document (or piece), the same each time."""

import pytest

from tarnfold.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    1: {"doc_id", "size", "source_size", "target", "taken"}, 2: {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    3: {"doc_id", "class_id"}, 4: {"doc_id", "n_tokens", "n_tokens_edited"}, 5: {"doc_id", "held_out", "score", "predicted"},
    6: {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, 7: {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    8: {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    9: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    10: {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
}


def number(name):
    return int(name[2:].split("_")[0])


def test_there_is_one_query_for_each_operator():
    assert sorted(map(number, QUERIES)) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows(spark, odd, texts, name):
    df = QUERIES[name](spark, odd)
    assert COLUMNS[number(name)] <= set(df.columns)
    rows = df.collect()
    if number(name) == 10:
        rows = [r for r in rows if r.piece == 0]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in texts)
    if number(name) != 10:
        assert sorted(map(str, QUERIES[name](spark, odd).collect())) == sorted(map(str, rows))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, bare, name):
    df = QUERIES[name](spark, bare)
    assert COLUMNS[number(name)] <= set(df.columns) and df.collect() == []
