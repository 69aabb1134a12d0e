"""Operations of a training-data pipeline over document tables.

Nothing outside this subpackage imports it; the queries over the driver's tables are in ``seqloom.llm.queries``.
"""
