from tabledeltas.plans.runner import Run, SqlFailure, changes_between, query_result, run_query

__all__ = ["Run", "SqlFailure", "changes_between", "query_result", "run_query"]
