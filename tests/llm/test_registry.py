import re

from tokenloom.llm import queries


def test_one_query_for_each_operator_and_sql_is_text():
    own = [re.match(r"op(\d+)_", k) for k in queries.QUERIES]
    assert [int(m.group(1)) for m in own if m] == list(range(1, 11))
    # besides, one over a table with tool calls, which the given one lacks
    assert [k for k, m in zip(queries.QUERIES, own) if not m] == ["linked_tool_calls"]
    assert set(queries.ORACLES) == {"op5_line_dedup", "op7_tool_call_linking", "linked_tool_calls", "op10_near_dedup"}
    assert all(isinstance(sql, str) for sql in queries.ORACLES.values())
