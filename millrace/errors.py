"""What the engine says and raises."""

# What statements that succeed say.
TABLE_CREATED, INDEX_CREATED, INSERTED = "Table created successfully", "Index created successfully", "Insert parsed successfully"
NO_ROWS, ONE_ROW, SOME_ROWS = "0 rows {done}", "1 row {done}", "{n} row(s) {done}"

# What statements that can't be carried out say.
TABLE_EXISTS, INDEX_EXISTS, NO_TABLE, NO_INDEX = '"table already exists"', "index already exists", "table '{name}' does not exist", "index '{name}' does not exist"
NO_KEY, MANY_KEYS = "table must contain exactly one PRIMARY KEY", "multiple PRIMARY KEY columns are not allowed"
UNKNOWN_COLUMN, MISSING_VALUE, COUNT_OF_VALUES = "unknown column '{name}'", "missing value for column '{name}'", "expected {expected} values but received {received}"
UPDATE_NEEDS_WHERE, DELETE_NEEDS_WHERE, KEY_IS_FIXED = "UPDATE without WHERE is not supported", "DELETE without WHERE is not supported", "updating the primary key is not supported"
WRONG_VALUE, TYPE_MISMATCH, LEFT_OF_WHERE = "Type mismatch: column '{name}' expects {expected} but received {received}", "type mismatch", "left side of WHERE must be a column"
NOT_GROUPED, STAR_IN_GROUPS, HAVING_ALONE = "Column '{name}' must appear in GROUP BY or be used in an aggregate function", "SELECT * cannot be used with GROUP BY or aggregates", "HAVING requires GROUP BY"
ONLY_INTEGERS = "{function} only supports INTEGER columns"


class QueryError(Exception):
    """A statement that can't be carried out; its text is the message shown after ``Error: ``."""


class ParseError(QueryError):
    """A statement that isn't one of the dialect."""
