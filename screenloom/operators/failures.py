"""What went wrong with a call of the model or with a candidate: kinds, codes, and whether to try again.

A failure comes as what was thrown, a status, and the error's own type and message. The tables below are
read in order, and the first row that fits counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What was thrown, the statuses it has, and its kind.
KINDS = (
    ("timeout", None, "timeout"),
    ("user_abort", None, "aborted"),
    ("connection", None, "connection"),
    ("api", (429, 429), "rate_limit"),
    ("api", (401, 401), "authentication"),
    ("api", (400, 400), "bad_request"),
    ("api", (500, 599), "server"),
    ("abort", None, "aborted"),
)
UNKNOWN = "unknown"
#: A kind's code, and whether another attempt may help.
CODES = {
    "timeout": ("AGENT_TIMEOUT", True),
    "aborted": ("AGENT_TIMEOUT", True),
    "rate_limit": ("AGENT_RATE_LIMIT", True),
    "connection": ("AGENT_UPSTREAM", True),
    "server": ("AGENT_UPSTREAM", True),
}
OTHERWISE = ("AGENT_UPSTREAM", False)
#: Types of a bad request that is too long, and the code of these and of schemas that are refused.
TOO_LONG, TOO_LARGE, REFUSED_SCHEMA = ("context_window_exceeded", "request_too_large"), "AGENT_INPUT_TOO_LARGE", "AGENT_SCHEMA_REJECTED"
#: Phrases of messages about a schema, by what they are a sign of. Those of the last one count in the
#: sentence that names the schema, up to NEAR characters behind it.
SIGNATURES = (
    ("too_many_union_parameters", ("parameters with type arrays", "parameters with unions")),
    ("union_compilation_cost", ("union-typed parameters", "union typed parameters", "exponential compilation")),
    ("too_many_optional_parameters", ("too many optional parameters", "optional parameters in your tool schemas", "grammar compilation")),
    ("schema_unsupported", ("not supported", "unsupported", "too deep", "too large", "too complex")),
)
NEAR = 80
#: What a candidate's row may say, and what it says where nothing better is known.
CANDIDATE_CODES = (
    "EXTRACTION_FAILED", "EMPTY_DOCUMENT", "AGENT_TIMEOUT", "AGENT_RATE_LIMIT", "AGENT_UPSTREAM", "AGENT_REFUSED", "AGENT_BAD_OUTPUT", "AGENT_INCOMPLETE_EVAL",
    "AGENT_INPUT_TOO_LARGE", "AGENT_SCHEMA_REJECTED", "AGENT_INVALID_ROLE", "AGENT_UNKNOWN_RULE", "SOURCE_FILE_MISSING",
)
UNSUPPORTED, FAILED = "UNSUPPORTED_FILE_TYPE", "EXTRACTION_FAILED"
GENERIC = "Screening this CV failed. Retry the candidate, or re-upload the CV if the problem persists."


def first_of(cases: list[tuple[Column, str]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def kind_of(thrown: Column, status: Column) -> Column:
    fits = [((thrown == name) & (F.lit(True) if span is None else F.coalesce(status.between(*span), F.lit(False))), kind) for name, span, kind in KINDS]
    return first_of([(F.coalesce(c, F.lit(False)), k) for c, k in fits], F.lit(UNKNOWN))


def schema_signature(message: Column) -> Column:
    """Which sign of a refused schema a message holds; null if none, or if it doesn't name the schema."""
    low = F.lower(message)

    def near(phrase: str) -> Column:
        def holds(sentence: Column) -> Column:
            before = F.substring_index(sentence, phrase, 1)
            return F.contains(sentence, F.lit(phrase)) & F.contains(before, F.lit("schema")) & (F.length(F.substring_index(before, "schema", -1)) <= NEAR)

        return F.exists(F.split(low, r"\."), holds)

    any_of = lambda conditions: F.array_contains(F.array(*conditions), True)
    cases = [(any_of([F.contains(low, F.lit(p)) for p in phrases]), name) for name, phrases in SIGNATURES[:-1]]
    cases.append((any_of([near(p) for p in SIGNATURES[-1][1]]), SIGNATURES[-1][0]))
    return F.when(F.contains(low, F.lit("schema")), first_of(cases, F.lit(None).cast("string")))


def call_failure(thrown: Column, status: Column, error_type: Column, message: Column) -> Column:
    """struct<kind, code, retryable, signature> of a call that failed."""
    kind = kind_of(thrown, status)
    bad = kind == "bad_request"
    long = bad & F.coalesce(error_type.isin(*TOO_LONG), F.lit(False))
    signature = F.when(bad & ~long, schema_signature(message))
    known = first_of([(kind == k, code) for k, (code, _) in CODES.items()], F.lit(OTHERWISE[0]))
    code = F.when(long, TOO_LARGE).when(signature.isNotNull(), REFUSED_SCHEMA).otherwise(known)
    again = kind.isin(*(k for k, (_, again) in CODES.items() if again))
    return F.struct(kind.alias("kind"), code.alias("code"), again.alias("retryable"), signature.alias("signature"))


def retry_after(status: Column, header: Column) -> Column:
    """Seconds that an error's answer asks to wait; null if it doesn't say so in a number that isn't negative."""
    seconds = header.try_cast("double")
    return F.when(status.isNotNull() & (seconds >= 0) & (seconds < float("inf")), seconds)


def candidate_failure(code: Column, retryable: Column, message: Column) -> Column:
    """struct<error_code, error_message, retryable>: what a candidate's row stores. A file of another type is an
    extraction that failed for good. Of an error that isn't known neither the code nor the message is told, since it may
    hold anything; it may be tried again."""
    known = F.coalesce(code.isin(*CANDIDATE_CODES), F.lit(False))
    stays = known | F.coalesce(code == UNSUPPORTED, F.lit(False))
    told = F.when(stays, F.coalesce(message, F.lit(GENERIC))).otherwise(F.lit(GENERIC))
    again = F.when(~stays, F.lit(True)).when(known, F.coalesce(retryable, F.lit(False))).otherwise(F.lit(False))
    return F.struct(F.when(known, code).otherwise(F.lit(FAILED)).alias("error_code"), told.alias("error_message"), again.alias("retryable"))
