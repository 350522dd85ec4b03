from conftest_llm import clashing, docs, empty, rows  # noqa: F401
