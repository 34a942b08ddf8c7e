"""Claims against what a project has."""

from tessella.operators import claims as C


def test_claims(spark):
    given = [
        ("a", "Call createUser() now", None), ("b", "The creates class", None), ("c", "nothing() then the gone function and other()", None), ("d", "See `src/app.ts` and set `Port` option", []), ("e", "plain words", []),
        ("f", "plain words", [("symbol", "createUser")]), ("g", "plain", [("symbol", "createUser"), ("symbol", "createuser"), ("file", "x")]), ("h", "lost() in `app.ts`", [("symbol", "no")]), ("i", None, None), ("j", "lost()", [("symbol", "createUser")]),
        ("j", "lost()", [("symbol", "createUser")]), ("k", "createuser() `missing.ts` `no` key", None),
    ]
    claims = spark.createDataFrame(given, "id string, text string, evidence array<struct<kind:string,value:string>>")
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    found = C.validate_claims(claims, one("createUser", "Recreates", None), one("src/app.ts", None), one("PORT"))
    got = {r.id: (r.status, r.valid, [(e.kind, e.value, e.confidence) for e in r.evidence]) for r in found.collect()}
    assert got == {
        "a": ("verified", True, [("symbol", "createuser", "verified")]), "b": ("verified", True, [("symbol", "creates", "inferred")]), "c": ("unsupported", False, []),
        "d": ("verified", True, [("config", "port", "verified"), ("file", "src/app.ts", "verified")]), "e": ("inferred", True, []), "f": ("verified", True, [("symbol", "createUser", "verified")]),
        "g": ("contradicted", False, [("symbol", "createUser", "verified")]), "h": ("unsupported", False, [("file", "app.ts", "verified")]), "i": ("inferred", True, []), "j": ("unsupported", False, [("symbol", "createUser", "verified")]),
        "k": ("verified", True, [("symbol", "createuser", "verified")]),
    }
    reasons = {r.id: r.reason for r in found.collect()}
    assert (reasons["c"], reasons["g"]) == ('Symbol "gone" not found in project.', 'Claimed evidence "createuser" not found.')
    row = C.summarize_claims(found).first()
    assert (row.total, row.verified, row.inferred, row.unsupported, row.contradicted, round(row.rate, 3)) == (11, 5, 2, 3, 1, 0.636)
    assert C.summarize_claims(found.limit(0)).first().rate == 1.0
    assert C.validate_claims(claims.limit(0), one(), one(), one()).count() == 0
