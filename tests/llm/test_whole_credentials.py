"""Problem 1: no line that a parser accepts is passed over."""

import pytest

from seamline.llm import p1_credentials as p1

PW = "Zx91!kqPw"
BODY = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3hJ5"
LINES = [
    f"x = github_pat_{BODY}{BODY}", f"x = rk_live_{BODY}", f"redis-cli -a {PW}", f"mongosh -u root -p {PW}", f"mysqldump -p{PW}", f"7z a -p{PW} a.7z b", f"zip -P {PW} a.zip b", f"smbclient //h/s -P {PW}", f"wget --user root:{PW} h", f"run -u root:{PW}",
    f'connect("root", "{PW}")', f'signin("root", "{PW}")', f'sign_in("root", "{PW}")', f'log_in("root", "{PW}")', f"用户：root / {PW}", f"user: root / {PW}", f"cuenta: root / {PW}", f"conta root, {PW}", f"凭据: '{BODY}'", f'x = "gh" + "p_{BODY}"',
    f"echo {PW}|sudo -S reboot", f"echo '{PW}' | su root", f"INSERT  INTO  app_clients VALUES (1, '{BODY}')",
]


@pytest.mark.parametrize("line", LINES)
def test_what_a_parser_accepts_has_a_trigger(line):
    assert [*p1._line_spans(line, ""), *p1._literals(line, 0, len(line))] and p1.spans(f"first\n{line}\nlast")


def test_key_path_of_a_long_block():
    filler = "".join(f"    a{k}: {k}\n" for k in range(900))
    assert [s.path for s in p1.spans(f"db:\n  main:\n{filler}    password: '{PW}'\nother:\n  password: '{PW}'\n")] == ["db.main.password", "other.password"]


TOKEN = f"ghp_{BODY}"
PAIRS = [
    ("db:\n  pass: |\n    Zx91!kqPw\n  n: 1\n", "yaml", "db.pass", 3), ("password:\n  Zx91!kqPw\n", "yml", "password", 2), ("- name: DB_PASSWORD\n  value: Zx91!kqPw\n", "yaml", "DB_PASSWORD", 2), ("auth: {token: 'TOKEN', n: 1}", "yaml", "auth.token", 1),
    ('[db]\npassword = """\nZx91!kqPw"""\n', "toml", "db.password", 3), ('[db]\nkeys = { api_key = "TOKEN" }\n', "toml", "db.keys.api_key", 2), ("[db]\npassword = Zx91\\\n  !kqPw\n", "ini", "db.password", 2), ("db.password=Zx91!kqPw", "properties", "db.password", 1),
    ('{"db":{"primary":{"password":"Zx91!kqPw"}}}', "json", "db.primary.password", 1), ('{"a":{"p\\u0061ssword":\n "Zx91!kqPw"}}', "json", "a.password", 2), ('{"a": [{"secret": {"value": "TOKEN"}}]}', None, "a.secret.value", 1), ("# x\n\n```yaml\na:\n  password: >-\n    Zx91!kqPw\n```\n", "md", "a.password", 6),
    ("<c><db password='Zx91!kqPw'/></c>", "xml", "c.db.password", 1), ("<c>\n<password>\nZx91!kqPw</password></c>", None, "c.password", 3), ('<c><add key="DbPassword" value="Zx91!kqPw"/></c>', "config", "c.DbPassword", 1), ("<dict><key>api_key</key>\n<string>TOKEN</string></dict>", "plist", "dict.api_key", 2),
    ('PASSWORD = (\n    "Zx91"\n    "!kqPw"\n)', "py", "PASSWORD", 2), ('password = """\nZx91!kqPw\n"""', "py", "password", 2), ('const apiKey =\n  "ghp_aB3dE5gH7jK9mN1pQ" +\n  "3sT5vW7yZ9bC1dF3hJ5";', "ts", "apiKey", 2),
]


@pytest.mark.parametrize(("text", "suffix", "path", "line"), PAIRS)
def test_key_paths_of_formats(text, suffix, path, line):
    text = text.replace("TOKEN", TOKEN)
    (s,) = p1.spans(text, suffix)
    assert (s.path, text.count("\n", 0, s.start) + 1) == (path, line)
    out = p1.masked(text, [s])
    assert len(out) == len(text) and p1.spans(out, suffix) == [] and all(a == b or b == "*" for a, b in zip(text, out))


def test_no_length_hides_a_secret():
    long = (BODY + "xY9") * 31
    for text in (f"client-key-data: {long}", f"API_TOKEN={long[:600]}", f"password: '{long[:300]}!'"):
        (s,) = p1.spans(text)
        assert s.end - s.start in (len(long), 600, 301)


def test_cut_documents():
    text = "x = 1\n" * 665 + "password: Zx91!kqPw"
    for cut in range(len(text) - 6, len(text)):
        assert [len(s) for *_, s in p1._by_field(None, text, text[:cut], None, cut)] == [1, 0]
    assert len(text) > 4000 and [len(s) for *_, s in p1._by_field(None, None, text, None, 4000)] == [1]
    assert [len(s) for *_, s in p1._by_field(None, text, text, None, len(text))] == [1, 1]


def test_many_in_a_line_and_their_bytes():
    text = "é: " + "; ".join(f"password='Zx{k}!kqPw'" for k in range(50))
    spans = p1.spans(text)
    assert len(spans) == 50 and all(a.end <= b.start for a, b in zip(spans, spans[1:]))
    raw, at = text.encode(), p1.byte_offsets(text, [o for s in spans for o in (s.start, s.end)])
    assert all(raw[at[2 * k] : at[2 * k + 1]].decode() == text[s.start : s.end] for k, s in enumerate(spans))


DAMAGED = ["", "{", '{"a', "a: |", "a: 'x", "[a", "<a", "<a b='", "x = '''", "-", "- - ", "```yaml\na: |\n```", "\x00", "key: " + "[" * 5000, "<a>" * 3000, "a:\n" * 2000, "'" * 3000, " a:\n" + "- " * 3000, '"a": "' * 3000]


@pytest.mark.parametrize("text", DAMAGED)
def test_damaged_formats_end(text):
    for suffix in (None, "json", "yaml", "toml", "xml"):
        p1.spans("password: x\n" + text, suffix)
        list(p1.p1_formats.pairs(text, suffix))


def test_lines_that_are_not_read_hold_nothing(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/gen_requests.parquet").select("full_document_text", "selected_text").collect()
    texts = {t for r in rows for t in r if t} | set(LINES) | {t for t, *_ in PAIRS}
    for text in texts:
        read = {text.count("\n", 0, a) for a, _ in p1._lines_to_read(text)}
        for k, line in enumerate(text.split("\n")):
            if k not in read:
                assert not p1._TRIGGER.search(line) and not list(p1._line_spans(line, "")) and not list(p1._literals(line, 0, len(line)))
