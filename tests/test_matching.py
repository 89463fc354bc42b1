"""Line rules, secrets, pairing, claims, CI rules and line counts against Python's re and direct loops."""

import random
import re

from conftest import rows

from codefacts.functions.matches import match_positions
from codefacts.operators import ci
from codefacts.operators import matching as mt
from codefacts.operators import rules as ru
from codefacts.sources import corpus as sc
from codefacts.sources import manifests as mf


def test_builtin_rules(make_files):
    files = make_files({
        "a.py": 'password = "hunter2hunter2"\n# password = "hunter2hunter2"\npwd = os.environ["PWD_LONG_NAME"]\ntoken=\'abcdefgh\'; secret = "ijklmnop"\napi_key = "changeme1"\n',
        "b.py": 'cur.execute(f"select {x}")\ncur.execute("a" + b)\ncur.execute("a %s" % b)\ncur.execute(sql, params)\n',
        "c.py": "requests.get(url)\nurlopen(x)\nmyurlopen(x)\n", "d.py": "requests.get(url)\ndef f(): validate_url(url)\n",
        "e.py": "if secret and got != secret:\n    pass\nif my_token_x and y:\n    pass\nif a and token:\n    pass\n",
    })
    got = rows(mt.line_rule_hits(files), "path", "line_no", "rule_id")
    assert got == [
        ("a.py", 1, "SEC001"), ("a.py", 4, "SEC001"), ("a.py", 4, "SEC001"), ("b.py", 1, "SEC005"), ("b.py", 2, "SEC005"), ("b.py", 3, "SEC005"),
        ("c.py", 1, "SEC002"), ("c.py", 2, "SEC002"), ("e.py", 1, "SEC003"), ("e.py", 3, "SEC003")]


def test_secret_text_pattern_like_python(spark):
    secret = re.compile(r"""(?i)(api[_-]?key|secret|token|access[_-]?key|passwd|password)\s*[:=]\s*(["'])(?!\{|\$\{|<\|%\{)[^"']{6,}\2""")
    sql = re.compile(r"""(?i)(f["'][^"']*\b(SELECT|INSERT|UPDATE|DELETE)\b[^"']*["'])|(["'][^"']*\b(SELECT|INSERT|UPDATE|DELETE)\b[^"']*["']\s*[%\+])""")
    rng = random.Random(1)
    words = ["api_key", "Secret", "token", "=", ":", " ", '"', "'", "abcdef", "${", "{", "SELECT", "select", "x", "%", "+", "f", "\n", "é"]
    texts = ["".join(rng.choice(words) for _ in range(25)) for _ in range(400)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", F.regexp_extract_all("t", F.lit(ru.SECRET_TEXT), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(ru.SQL_TEXT), F.lit(0)).alias("b"))
    for r in out.collect():
        assert r.a == [m.group(0) for m in secret.finditer(texts[r.i])], repr(texts[r.i])
        assert r.b == [m.group(0) for m in sql.finditer(texts[r.i])], repr(texts[r.i])


def brute_pairs(lines, assign, use, escape, window):
    going_on = ("try:", "if ", "except", "for ", "with ", "else", "elif", "while", "finally")
    hits = []
    for i, line in enumerate(lines):
        m = re.match(assign, line)
        if not m:
            continue
        indent = len(line) - len(line.lstrip())
        for j in range(i + 1, min(i + window, len(lines))):
            s = lines[j].strip()
            if not s:
                continue
            if len(lines[j]) - len(lines[j].lstrip()) < indent and not s.startswith(going_on):
                break
            if escape and re.search(escape, s):
                break
            if re.search(use.format(var=re.escape(m.group(1))), s):
                hits.append((j + 1, s[:120]))
                break
    return hits


def test_pairing_like_a_loop(spark, make_files):
    rng = random.Random(4)
    pool = ["c = get_raw_connection()", "    d = db.get_raw_connection()", "c.execute(q)", "    d.execute(q)", "  c.cursor()", "c = PgConnection(c)", "", "def f():", "if x:", "else:", "    pass", "cc.execute(1)", "row = c.execute(q)", "    return d.execute(q)"]
    texts = {f"f{i:03}.py": "\n".join(rng.choice(pool) for _ in range(12)) for i in range(150)}
    rule = mt.RAW_CONNECTION
    for window in (40, 4):
        got = mt.pair_rule_hits(make_files(texts), (mt.PairRule(rule.name, rule.assign, rule.use, rule.escape, window),))
        want = [(p, n, s) for p, t in texts.items() for n, s in brute_pairs(t.splitlines(), rule.assign, rule.use, rule.escape, window)]
        assert rows(got, "path", "line_no", "snippet") == sorted(want, key=repr)


def test_variables_that_are_not_used_ahead_are_left_out(spark):
    """Line facts and uses are only worked out for a variable that a line of its window holds."""
    from pyspark.sql import functions as F

    raw = ["a = open()", "b = open()", "", "use(a)", "use(b)", "a"]
    df = spark.createDataFrame([(raw, ["a", "b", "", "", "", "a"])], "raw array<string>, vars array<string>")
    rule = mt.PairRule("open", assign=r"(\w) = open", use=r"use\({var}\)", window=3)
    assert df.select(mt._used_ahead(rule, F.col("vars"))).first()[0] == ["", "", "", "", "", ""]
    longer = mt.PairRule("open", assign=rule.assign, use=rule.use, window=4)
    assert df.select(mt._used_ahead(longer, F.col("vars"))).first()[0] == ["a", "b", "", "", "", ""]
    unsure = mt.PairRule("open", assign=rule.assign, use=r"use\({var}\)|drop", window=3)
    assert df.select(mt._used_ahead(unsure, F.col("vars"))).first()[0] == ["a", "b", "", "", "", "a"]


def test_uses_anywhere_in_their_line(make_files):
    body = "conn = get_raw_connection()\nrow = conn.execute(q)\n\ndef f():\n    db = pool.get_raw_connection()\n    return db.execute(q)\n"
    late = "x = 1; conn = get_raw_connection()\nconn.execute(q)\n"
    files = make_files({"a.py": body, "b.py": late, "c.py": ""})
    assert rows(mt.pair_rule_hits(files), "path", "line_no", "snippet") == [("a.py", 2, "row = conn.execute(q)"), ("a.py", 6, "return db.execute(q)")]
    anywhere = mt.PairRule("open", assign=r"(\w+) = open\(", use=r"send\({var}\)|(?i)drop {var}", window=3)
    both = mt.pair_rule_hits(make_files({"d.py": "f = open(p)\ny = send(f)\n", "e.py": "  f = open(p)\n", "g.py": "g = open(p)\nDROP G\nconn = get_raw_connection()\nconn.execute(1)\n"}), (mt.RAW_CONNECTION, anywhere))
    assert rows(both, "path", "rule", "line_no") == [("d.py", "open", 2), ("g.py", "open", 2), ("g.py", "raw_db_conn_execute", 4)]


def test_claims(spark, make_files):
    files = make_files({"a.py": "one\ntwo\nthree two\n"})
    claims = spark.createDataFrame(
        [("r", "1", "a.py", "two", None), ("r", "2", "a.py", "two", 3), ("r", "3", "a.py", "one", 2), ("r", "4", "gone.py", "x", None), ("r", "5", "a.py", "four", None), ("r", "6", "a.py", "x", 99)],
        "repo string, id string, path string, must_contain string, line int")
    got = {r.id: (r.status, r.reason) for r in mt.check_claims(claims, files).collect()}
    assert got == {"1": ("PASS", "found on line 2"), "2": ("PASS", "text is on the line"), "3": ("FAIL", "text is not on the line"), "4": ("FAIL", "no such file"),
                   "5": ("FAIL", "text not found"), "6": ("FAIL", "text is not on the line")}


def test_claim_and_rule_sources(spark):
    docs = spark.createDataFrame([("r", '[{"id": "a", "file": "x.py", "contains": "t"}, {"file": "y.py", "must_contain": "u", "line": 3}]')], "repo string, content string")
    assert rows(mf.read_claims(docs), "id", "path", "must_contain", "line") == [("?", "y.py", "u", 3), ("a", "x.py", "t", None)]
    pair = spark.createDataFrame([('[{"name": "n", "assign": "a", "use": "u"}]',)], "content string")
    assert rows(mf.read_pair_rules(pair), "name", "escape", "window", "desc") == [("n", "", 40, "n")]
    mixed = spark.createDataFrame([('[{"name": "n", "use": "u"}, {"name": "m", "assign": "a", "use": "u", "window": 3}, {"use": "u"}, 7]',), ("no json",), (None,)], "content string")
    assert rows(mf.read_pair_rules(mixed), "seq", "name", "window") == [(1, "m", 3)]
    assert rows(mf.rejected_pair_rules(mixed), "seq", "reason") == [(0, "pairing rule lacks assign"), (2, "pairing rule lacks name"), (3, "pairing rule lacks name")]
    claims = spark.createDataFrame([("r", '[{"id": "a", "file": "x.py"}, {"file": "y.py", "contains": "u"}]')], "repo string, content string")
    assert rows(mf.read_claims(claims), "seq", "must_contain") == [(1, "u")]
    assert rows(mf.rejected_claims(claims)) == [("r", 0, "claim lacks must_contain", '{"file":"x.py","id":"a"}')]


def test_rules_of_repositories(make_files):
    files = make_files({
        "audit_rules.json": '{"rules": [{"rule_id": "A1", "severity": "major", "dimension": "quality", "title": "t", "matcher": {"type": "regex_line", "pattern": "todo", "guard_anywhere": ["SAFE"]}}, {"note": "no id"}]}',
        ".audit/audit_rules.json": '[{"rule_id": "A2"}]', "x.py": "# todo\nx = 1  # todo\n", "y.py": "todo SAFE\n"})
    rules = mf.read_rules(files)
    assert rows(rules, "rule_id", "pattern") == [("A1", "todo")]
    assert rows(mt.repo_rule_hits(files.where("path like '%.py'"), rules), "path", "line_no", "rule_id") == [("x.py", 2, "A1")]


def rule_table(spark, rules):
    schema = "repo string, seq int, rule_id string, dimension string, severity string, title string, confidence string, matcher string, pattern string, guards array<string>"
    return spark.createDataFrame([(r, k, f"R{k}", "quality", "info", "t", None, "regex_line", p, g) for k, (r, p, g) in enumerate(rules)], schema)


def test_bad_patterns_are_rejects_and_the_rest_goes_on(spark, make_files, monkeypatch):
    patterns = ["(", "todo", None, "a{2,1}", r"\d+ left", "x?y", "FIXME|later", r"(?i)HACK", r"\x41B", "[ab]c(de)?f", "*", "", r"q\.z+"]
    rules = rule_table(spark, [("r", p, []) for p in patterns] + [("s", "todo", []), ("r", "todo", ["SAFE"])])
    assert rows(mt.rejected_rules(rules), "repo", "rule_id") == [("r", "R0"), ("r", "R10"), ("r", "R2"), ("r", "R3")]
    lines = ["todo", "7 left", "y", "xy", "later", "# todo", "hack", "AB", "bcf", "acdef", "q.zz", "qxz", "nothing", "todo FIXME"]
    texts = {"one.py": "\n".join(lines), "two.py": "SAFE\ntodo\n", "none.py": ""}
    import re
    want = []
    for p, body in texts.items():
        for k, (repo, pattern, guards) in enumerate([("r", p, []) for p in patterns] + [("s", "todo", []), ("r", "todo", ["SAFE"])]):
            if repo == "r" and k not in (0, 2, 3, 10) and not any(g in body for g in guards):
                want += [(p, n, f"R{k}") for n, line in enumerate(body.splitlines(), 1) if not line.startswith("#") and re.search(pattern, line)]
    for size in (mt.RULE_BYTES, 0):  # rules sent to the files, and both sides dealt out
        monkeypatch.setattr(mt, "RULE_BYTES", size)
        monkeypatch.setattr(mt, "RULE_CHUNK", 3)
        assert rows(mt.repo_rule_hits(make_files(texts), rules), "path", "line_no", "rule_id") == sorted(want, key=repr)


def test_required_literals(spark):
    from pyspark.sql import functions as F

    cases = {"todo": "todo", r"\bimport os\b": "import os", "colou?r": "colo", "ab*cd": "cd", "ab+cd": "ab", "x{3}yz": "yz", "a|bcd": "", "(abc)?d": "", "(abc)+d": "abc", "[xyz]*abc": "abc",
             r"\p{Lu}bc": "", "(?i)abc": "", r"a\.bcd": "bcd", r"\Qa|b\E": "", "": "", "[a[bc]]d": "", "^def main$": "def main", "a??bc": "bc"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.x for r in df.select("p", mt.required_literal(F.col("p")).alias("x")).collect()} == cases


def test_match_positions(spark):
    from pyspark.sql import functions as F

    body = "ab x1\n# x2 x3\n\nx4"
    got = spark.createDataFrame([(body,)], "t string").select(match_positions(F.col("t"), r"x\d").alias("m")).first().m
    assert [(m.match, m.line, m.before) for m in got] == [("x1", 1, "ab "), ("x2", 2, "# "), ("x3", 2, "# x2 "), ("x4", 4, "")]


def test_ci_rules(make_files):
    sha = "a" * 40
    files = make_files({
        ".github/workflows/a.yml": f"uses: o/a@{sha}\nuses: o/b@v1\nshell: bash\n# password: x\npassword: 'y'\npwd: z\nsecret=abcdefghijklmnop\necho ::set-output\n",
        ".github/workflows/sub/ignored.yml": "", ".gitee/workflows/b.yml": "x", ".github/workflows/c.yaml": "timeout-minutes: 1\n",
    })
    wf = sc.workflow_files(files)
    assert sorted(r.path for r in wf.collect()) == [".github/workflows/a.yml", ".github/workflows/c.yaml"]
    got = rows(ci.workflow_findings(wf), "rule_id", "line")
    assert got == [("CI001", 2), ("CI002", None), ("CI003", 5), ("CI003", 7), ("CI004", None), ("CI005", None)]
    gitee = make_files({".gitee/workflows/b.yml": "registry.npmjs.org\ntoken: abcdefghijklmnopq\n"})
    assert rows(ci.workflow_findings(sc.workflow_files(gitee)), "rule_id", "line") == [("GG001", None), ("GG002", 2)]


def test_sloc_blocks(make_files):
    files = make_files({"a.js": "/* a\n b */ x\ny /* z */\n// c\n\n/* d */\n/* e\n", "b.py": '# c\nx\n"""\n', "c.html": "<!-- a\n-->\n<p>\n", "d.md": "# t\n\n", "e.bin": "x"})
    got = {r.path: (r.code, r.comment, r.blank) for r in mt.sloc(files).collect()}
    assert got == {"a.js": (1, 5, 1), "b.py": (2, 1, 0), "c.html": (1, 2, 0), "d.md": (1, 0, 1)}
    assert rows(mt.sloc_by_module(mt.sloc(files)), "module", "files", "code") == [("<root>", 3, 4)]
