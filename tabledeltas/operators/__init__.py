from tabledeltas.operators.changes import (
    KeyViolation,
    SchemaChange,
    apply_changes,
    assert_key,
    change_feed,
    deletes,
    inserts,
    updates,
)
from tabledeltas.operators.latest import as_table, fold_latest, project_value

__all__ = [
    "KeyViolation",
    "SchemaChange",
    "apply_changes",
    "as_table",
    "assert_key",
    "change_feed",
    "deletes",
    "fold_latest",
    "inserts",
    "project_value",
    "updates",
]
