"""Text functions over Columns. Everything stays in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that count as white space around SQL text.
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"

# Statements that read; a number may stand between these characters.
READING = ["SELECT", "SHOW", "WITH", "VALUES", "EXPLAIN", "FETCH"]
TX_CONTROL = ["BEGIN", "COMMIT", "ROLLBACK"]
_EDGE = rf"{_SPACE},()=<>+\-*/;"
_DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"

TRUNCATED = "... [truncated]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | text.startswith(prefix)
    return test


def truncate_text(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last ones being the marker."""
    if limit <= 0:
        return text
    keep = limit - len(TRUNCATED)
    cut = F.left(text, F.lit(limit)) if keep <= 0 else F.concat(F.left(text, F.lit(keep)), F.lit(TRUNCATED))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")


def one_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, rf"[\x00-\x1f\x7f{_SPACE}]+", " "))


def compact_query(text: Column, limit: int) -> Column:
    line = one_line(text)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.left(line, F.lit(limit - 3)), F.lit("...")))


def normalize_sql(sql: Column) -> Column:
    """Query template: literals become '?', free-standing numbers ?, spaces collapse."""
    literals = F.regexp_replace(sql, "'(?:[^']|'')*+'?", "'?'")
    numbers = F.regexp_replace(literals, rf"(?<![^{_EDGE}]){_DIGIT}(?:{_DIGIT}|\.)*+(?![^{_EDGE}])", "?")
    return F.btrim(F.regexp_replace(numbers, rf"[{_SPACE}]+", " "))


def infer_operation(query: Column, extended: Column | bool = False) -> Column:
    """Operation name of a statement; ``extended`` marks prepared execution."""
    head = F.upper(strip(query))
    name = F.when(F.lit(extended) if isinstance(extended, bool) else extended, F.lit("Execute"))
    name = name.when(starts_with_any(head, READING), F.lit("Query")).otherwise(F.lit("Exec"))
    return F.coalesce(tx_control(query), name)


def tx_control(query: Column) -> Column:
    """BEGIN, COMMIT or ROLLBACK when the text starts so, else null."""
    head = F.upper(strip(query))
    word = F
    for name in TX_CONTROL:
        word = word.when(head.startswith(name), F.lit(name))
    return word


def is_read_only(query: Column) -> Column:
    """Does the text read only, once leading comments are taken off?"""
    body = F.regexp_replace(query, rf"(?s)\A(?:[{_SPACE}]|--[^\n]*+(?:\n|\z)|/\*.*?\*/)*+", "")
    return starts_with_any(F.upper(body), READING)


def is_nplus1_candidate(operation: Column, query: Column) -> Column:
    head = F.upper(strip(query))
    return (
        operation.isin("Query", "Exec", "Execute")
        & starts_with_any(head, ["SELECT", "WITH"])
        & F.concat(F.lit(" "), head, F.lit(" ")).contains(" FROM ")
    )


def args_signature(args: Column, query: Column) -> Column:
    return F.when(F.size(args) > 0, F.array_join(args, "|")).otherwise(query)


def event_status() -> Column:
    hits = F.col("n_plus_1_hits").cast("string")
    return (
        F.when(F.col("error") != "", "ERROR")
        .when(F.col("n_plus_1") & F.col("slow"), F.concat(F.lit("N+1+S("), hits, F.lit(")")))
        .when(F.col("n_plus_1"), F.concat(F.lit("N+1("), hits, F.lit(")")))
        .when(F.col("slow"), "SLOW")
        .otherwise("OK")
    )


def shown_status() -> Column:
    """The server's tag, or the status label where there is none."""
    return F.when(F.col("status_tag") != "", F.col("status_tag")).otherwise(event_status())


def event_markers() -> Column:
    marks = F.array_compact(F.array(
        F.when(F.col("error") != "", "ERROR"),
        F.when(F.col("n_plus_1"), F.format_string("N+1[%d/%d]", "n_plus_1_hits", "n_plus_1_distinct_args")),
        F.when(F.col("slow"), "SLOW"),
    ))
    tag = F.when(F.col("status_tag") != "", F.col("status_tag")).otherwise(F.lit("OK"))
    return sanitize(F.when(F.size(marks) > 0, F.array_join(marks, ",")).otherwise(tag))


_PLACEHOLDER = r"\$(\d+)"


def _arg_at(args: Column, position: Column) -> Column:
    """Argument at a 1-based position, null outside the list."""
    return F.when((position >= 1) & (position <= F.size(args)), F.get(args, (position - 1).cast("int")))


def _positions(query: Column) -> Column:
    digits = F.regexp_extract_all(query, F.lit(_PLACEHOLDER), F.lit(1))
    # Numbers too long for a bigint are outside every argument list.
    return F.transform(digits, lambda d: F.coalesce(d.try_cast("bigint"), F.lit(9223372036854775807)))


def bind_preview(query: Column, args: Column) -> Column:
    """Put quoted arguments in place of $n; unknown positions stay as they are."""
    marks = F.regexp_extract_all(query, F.lit(r"(\$\d+)"), F.lit(1))
    shown = F.zip_with(marks, _positions(query), lambda mark, at: F.coalesce(
        F.when(_arg_at(args, at) == "NULL", F.lit("NULL")).otherwise(
            F.concat(F.lit("'"), F.replace(_arg_at(args, at), F.lit("'"), F.lit("''")), F.lit("'"))),
        mark,
    ))
    pieces = F.split(query, _PLACEHOLDER, -1)
    return F.array_join(F.zip_with(pieces, shown, lambda piece, arg: F.concat(piece, F.coalesce(arg, F.lit("")))), "")


def sql_literal(value: Column) -> Column:
    doubled = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.when(value == "NULL", F.lit("NULL")).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))


def explain_script(query: Column, args: Column, name: Column, analyze: bool = False) -> Column:
    """Statements that explain the query, as an array; nothing is executed."""
    prefix = F.lit("EXPLAIN ANALYZE " if analyze else "EXPLAIN ")
    positions = F.array_sort(F.array_distinct(_positions(query)))
    values = F.transform(positions, lambda at: sql_literal(F.coalesce(_arg_at(args, at), F.lit("NULL"))))
    prepared = F.array(
        F.concat(F.lit("PREPARE "), name, F.lit(" AS "), query),
        F.concat(prefix, F.lit("EXECUTE "), name, F.lit(" ("), F.array_join(values, ", "), F.lit(")")),
        F.concat(F.lit("DEALLOCATE "), name),
    )
    return F.when(F.size(positions) == 0, F.array(F.concat(prefix, query))).otherwise(prepared)


def format_ms(ms: Column) -> Column:
    return (
        F.when(ms < 1.0, F.format_string("%.0fus", ms * 1000.0))
        .when(ms < 1000.0, F.format_string("%.1fms", ms))
        .otherwise(F.format_string("%.2fs", ms / 1000.0))
    )


def _part(us: Column, unit: int, most: int) -> Column:
    """Hours, minutes or seconds of a UTC time of day, as two digits."""
    return F.lpad(F.pmod(F.floor((us - F.pmod(us, F.lit(unit))) / F.lit(unit)), F.lit(most)).cast("string"), 2, "0")


def utc_date(us: Column) -> Column:
    day = F.lit(86_400_000_000)
    return F.date_add(F.lit("1970-01-01").cast("date"), ((us - F.pmod(us, day)) / day).cast("int")).cast("string")


def clock_time(us: Column) -> Column:
    """Time of day in UTC, whatever zone the session is in."""
    return F.concat_ws(":", _part(us, 3_600_000_000, 24), _part(us, 60_000_000, 60), _part(us, 1_000_000, 60))


def iso_time(us: Column) -> Column:
    """ISO text in UTC; the fraction is left out where it is zero."""
    fraction = F.pmod(us, F.lit(1_000_000))
    return F.concat(
        utc_date(us), F.lit("T"), clock_time(us),
        F.when(fraction == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))),
        F.lit("+00:00"),
    )


def clock_time_ms(us: Column) -> Column:
    thousandths = F.pmod(F.floor((us - F.pmod(us, F.lit(1000))) / F.lit(1000)), F.lit(1000))
    return F.concat(clock_time(us), F.lit("."), F.lpad(thousandths.cast("string"), 3, "0"))


def duration_seconds(token: Column) -> Column:
    """Seconds of a duration token; null where it is not one."""
    pattern = r"^(?i)(\d+(?:\.\d+)?)(us|µs|ms|s|m)$"
    text = strip(token)
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    return (
        F.when(unit.isin("us", "µs"), number / 1_000_000.0)
        .when(unit == "ms", number / 1000.0)
        .when(unit == "s", number)
        .when(unit == "m", number * 60.0)
    )


def escape_pipe(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def event_line() -> Column:
    """One console line per event."""
    return F.format_string(
        "[%s] %-8s %8.2f ms rows=%-5d resp_rows=%-5d resp_bytes=%-7d conn=%s status=%s query=%s",
        clock_time(F.col("started_us")), F.col("operation"), F.col("duration_ms"), F.col("rows_affected"),
        F.col("response_total_rows"), F.col("response_total_bytes"), F.col("connection_id"),
        event_markers(), compact_query(F.col("query"), 120),
    )


def response_lines() -> Column:
    """Lines that sum up the response of an event, as an array."""
    total, rows = F.col("response_total_rows"), F.col("response_rows")
    kept = F.size(rows)
    suffix = F.when(F.col("response_truncated"), " [truncated]").otherwise("")
    sizes = F.array(F.format_string("response_size: rows=%d bytes=%d", total, F.col("response_total_bytes")))
    names = F.when(F.size("response_columns") > 0, F.array(F.concat(
        F.lit("columns: "), F.array_join(F.transform("response_columns", sanitize), " | "))))
    shown = F.when(kept > 0, F.transform(rows, lambda row, at: F.concat(
        F.lit("row "), (at + 1).cast("string"), F.lit(": "), F.array_join(F.transform(row, sanitize), " | "),
    ))).otherwise(F.array(F.lit("rows: (no preview rows)")))
    note = F.when(total > 0, F.array(F.concat(F.format_string("preview: %d of %d", kept, total), suffix))).when(
        F.col("response_truncated"), F.array(F.lit("preview: truncated")))
    none = F.array().cast("array<string>")
    return F.concat(sizes, F.coalesce(names, none), shown, F.coalesce(note, none))
