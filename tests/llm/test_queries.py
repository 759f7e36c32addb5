import corpus_pipeline
from profilescope.llm import queries


def test_every_operator_is_registered_once_and_sql_is_text():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert all(isinstance(sql, str) for sql in queries.ORACLE.values())
    assert queries.ORACLE.keys() <= queries.QUERIES.keys()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "secrets", "packing",
    ]
