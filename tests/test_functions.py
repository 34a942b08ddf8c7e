"""Scalar functions on single values."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def run(column):
        return one.select(column.alias("v")).first().v

    return run


@pytest.mark.parametrize(
    "build, expected",
    [
        (lambda: X.describe(F.lit("A short description.")), "A short description."),
        (lambda: X.describe(F.lit("Use `code`, **bold** and [label](x.md).")), "Use code, bold and label."),
        (lambda: X.describe(F.lit(" ".join(f"word{i}" for i in range(1, 61)))), " ".join(f"word{i}" for i in range(1, 25))),
        (lambda: X.truncate_words(F.lit("alpha beta gamma"), 12), "alpha beta"),
        (lambda: X.truncate_words(F.lit("alphabetagamma"), 5), "alpha"),
        (lambda: X.hash16(F.lit("hello")), "2cf24dba5fb0a30e"),
        (lambda: X.fnv1a32(F.lit("hello")), "4f9f2cab"),
        (lambda: X.stable_id("ex", F.lit("")), "ex"),
        (lambda: X.slugify_heading(F.lit("  Hello, World_1! ")), "hello-world_1"),
        (lambda: X.slugify_file(F.lit("Hello, World_1!")), "hello-world-1"),
        (lambda: X.slugify_page(F.lit("Héllo World!")), "h-llo-world"),
        (lambda: X.title_case(F.lit("api-REST_v2--guide")), "Api REST V2 Guide"),
        (lambda: X.redact(F.lit("key sk-abcdefghij0123456789 end")), "key [REDACTED] end"),
        (lambda: X.redact(F.lit("POSTGRES://u:p@host/db")), "[REDACTED]/db"),
        (lambda: X.sanitize_config_value(F.lit("authToken"), F.lit("x")), "[REDACTED]"),
        (lambda: X.strip_semantics(F.lit("a = 1; /* x */\n\n  // note\nb = '//c'\n")), "a = 1;\nb = '//c'"),
        (lambda: X.package_name(F.lit("@scope/name/deep")), "@scope/name"),
        (lambda: X.package_name(F.lit("../x")), None),
        (lambda: X.compare_versions(F.lit("1.2.3-beta"), F.lit("1.2.3")), -1),
        (lambda: X.compare_versions(F.lit("2"), F.lit("1.9.9")), 1),
        (lambda: X.satisfies_version(F.lit("1.4.0"), F.lit("^1.2.0")), True),
        (lambda: X.satisfies_version(F.lit("1.4.0"), F.lit("~1.2.0")), False),
        (lambda: X.satisfies_version(F.lit("1.4.0"), F.lit("")), True),
        (lambda: X.satisfies_version(F.lit("1.4.0"), F.lit(">x")), False),
        (lambda: F.array_join(X.export_names(F.lit("export const a=1; export { b as c, d };")), ","), "a,c,d"),
        (lambda: X.is_calendar_date(F.lit("2026-13-99")), False),
        (lambda: X.is_calendar_date(F.lit("2024-02-29")), True),
        (lambda: X.dedent_example(F.lit("    a\n      b\n\n    c")), "a\n  b\n\nc"),
        (lambda: X.markdown_description(F.lit("# T\n\nFirst *one*.\n\nSecond.")), "First one."),
        (lambda: X.normalize_body(F.lit("a\r\n\r\n\r\n\r\nb  ")), "a\n\nb\n"),
        (lambda: P.resolve_target(F.lit("guide"), F.lit("../api/x.md#a")), "api/x"),
        (lambda: P.resolve_target(F.lit("."), F.lit("guide/index.md")), "guide"),
        (lambda: P.relative_path(F.lit("a/b"), F.lit("a/c/d.md")), "../c/d.md"),
        (lambda: P.title_from_path(F.lit("getting-started/index.md")), "Getting Started"),
        (lambda: P.title_from_path(F.lit("index.md")), "Home"),
        (lambda: P.route_of(P.slug_from_path(F.lit("index.md"))), "/"),
        (lambda: P.page_kind(F.lit("blog/a.md")), "blog"),
        (lambda: P.is_within(F.lit("a"), F.lit("a/../b")), False),
    ],
)
def test_value(value, build, expected):
    assert value(build()) == expected
