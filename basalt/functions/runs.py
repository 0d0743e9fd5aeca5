"""What the output of a run says: broken environments, failure signatures, first frames, stable texts.

Marker lists are fixed values. Nulls count as empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import content_hash, quoted

DEPENDENCY = ["modulenotfounderror", "no module named", "command not found", "importerror while loading conftest", "error loading plugin", "sklearn.__check_build._check_build", "cannot import name '_c_internal_utils'", "cannot import name 'testdir' from '_pytest.pytester'"]
SELECTOR = ["collected 0 items", "no tests ran", "not found:", "ran 0 tests", "does not match any test", "unknown test", "invalid test label"]
SERVICE = ["could not connect", "connection refused", "temporary failure in name resolution", "external service", "database is unavailable", "network is unreachable", "database backend is required"]
RUNTIME = ["permission denied", "read-only file system", "no space left on device", "could not create", "failed to create process", "settings are not configured", "requested setting ", "settings.databases is improperly configured", "database settings are improperly configured", "please supply the name value", "appregistrynotready", "apps aren't loaded yet", "cannot import name 'mapping' from 'collections'", "remotetestresult' object has no attribute 'addduration'", "was removed in the numpy 2.0 release"]
BLOCKED = ["no module named", "modulenotfounderror", "command not found", "no such file or directory", "failed to create process", "importerror while loading conftest", "connection refused", "could not connect to server", "temporary failure in name resolution", "no tests ran", "collected 0 items"]
LAST_LINES, LAST_CHARS = 40, 12_000


def diagnostic(stdout: Column, stderr: Column) -> Column:
    return F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))


def _says(text: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def infrastructure_failure(stdout: Column, stderr: Column, return_code: Column) -> Column:
    """Why a run says nothing of the code; null if it does."""
    text = F.lower(diagnostic(stdout, stderr))
    return (
        F.when(_says(text, DEPENDENCY), "DEPENDENCY_MISSING")
        .when(_says(text, SELECTOR), "INVALID_SELECTOR")
        .when(_says(text, SERVICE), "EXTERNAL_SERVICE_REQUIRED")
        .when(_says(text, RUNTIME), "UNSUPPORTED_RUNTIME")
        .when(return_code.isin(4, 5), "COLLECTION_BROKEN")
    )


def environment_blocked(stdout: Column, stderr: Column) -> Column:
    text = F.lower(diagnostic(stdout, stderr))
    return _says(text, BLOCKED) | text.rlike("fixture ['\"][^'\"]+['\"] not found") | text.rlike("cannot import name ['\"]_[a-z0-9_]+")


def failure_signature(status: Column, return_code: Column, stdout: Column, stderr: Column) -> Column:
    """Hash of status, return code and the output's end without places, paths, durations and seeds; null for a pass."""
    text = diagnostic(stdout, stderr)
    text = F.when(F.length(text) > LAST_CHARS, F.substring(text, -LAST_CHARS, LAST_CHARS)).otherwise(text)
    for pattern, put in (
        (r"(?<=, line )\d+", "<line>"),
        (r"(?m)(\.py):\d+(?=[:\s])", "$1:<line>"),
        (r"(?:[A-Za-z]:)?[/\\][^\s:\n]+", "<path>"),
        (r"\b\d+(?:\.\d+)?s\b", "<duration>"),
        (r"(?mi)^(random seed:\s*)\d+\s*$", "$1<seed>"),
        (r"(?i)\bin\s+\d+(?:\.\d+)?\s+seconds?\b", "in <duration>"),
    ):
        text = F.regexp_replace(text, pattern, put)
    code = F.coalesce(return_code.cast("string"), F.lit("null"))
    body = F.concat(F.lit('{"diagnostic":'), quoted(text), F.lit(',"return_code":'), code, F.lit(',"status":'), quoted(status), F.lit("}"))
    return F.when(status != "PASS", content_hash(body))


def stable_text(value: Column) -> Column:
    """The last lines of a mechanical failure without paths, places and addresses."""
    text = F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), 'File "[^"]+", line \\d+', 'File "<PATH>", line <LINE>')
    text = F.regexp_replace(text, "0x[0-9a-fA-F]+", "0x<ADDR>")
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\r\n|\n|\r")
    last = F.slice(lines, F.greatest(F.size(lines) - LAST_LINES + 1, F.lit(1)), F.lit(LAST_LINES))
    return F.regexp_replace(F.array_join(F.transform(last, lambda x: F.regexp_replace(x, "\\s+$", "")), "\n"), "^\\s+|\\s+$", "")
