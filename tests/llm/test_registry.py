from triage_spark.llm import registry


def test_oracles_are_sql_of_registered_queries():
    assert set(registry.ORACLE) <= set(registry.QUERIES) and all(isinstance(s, str) for s in registry.ORACLE.values())
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
