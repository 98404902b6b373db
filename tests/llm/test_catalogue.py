"""The corpus queries are registered, and the rest of the library does without them."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_one_query_for_each_operator():
    names = list(entry.queries())
    assert [sum(bool(re.match(rf"op{n}_", x)) for x in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_nothing_else_imports_the_corpus_operators():
    for path in [*ROOT.glob("*.py"), *(ROOT / "demandloom").rglob("*.py"), *(ROOT / "tests").glob("*.py"), *(ROOT / "tools").glob("*.py")]:
        if path.name not in ("corpus_pipeline.py", "__spark_entry__.py") and "llm" not in path.parts:
            assert not re.search(r"demandloom\.llm|from demandloom import .*llm|corpus_pipeline", path.read_text()), path
