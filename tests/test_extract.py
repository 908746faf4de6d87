"""Lexer, parsers and tag pipeline on statements built from constructs whose
effect is known from how they are built, and on each limit of the settings."""

import random
import re
from urllib.parse import quote

import pytest

from tagmeter.functions import dsl, lexer, pairs
from tagmeter.operators.extract import extract
from tagmeter.plans.settings import Settings

DECOY = "/*job:decoy*/"


def tags_of(query, location=-1, length=0, scs=True, **settings):
    return extract(Settings(**settings), query, location, length, scs=scs)["tags"]


# ---- constructs: text that a lexer must pass over whole ----
def literal(rng):
    return "'" + rng.choice(["", "it''s ", "日本 "]) + DECOY + "'"


def escaped(rng):
    return rng.choice("eE") + "'" + rng.choice([r"a\'", r"\\", r"\\\'", "''"]) + DECOY + "'"


def unicode_literal(rng):
    return rng.choice(["u&", "U&"]) + "'" + rng.choice(["\\", r"\0041", ""]) + DECOY + "'"


def identifier(rng):
    return rng.choice(["", "U&"]) + '"' + rng.choice(["", 'q""q', "\\"]) + DECOY + '"'


def dollar(rng):
    tag = rng.choice(["$$", "$t$", "$_x1$", "$é$"])
    return tag + rng.choice(["", "'", "$", "$other$ "]) + DECOY + tag


def line_comment(rng):
    return "-- " + DECOY + rng.choice(["", " '", " /*"]) + "\n"


def nested_comment(rng):
    inner = "/* remark */"
    for _ in range(rng.randrange(3)):
        inner = f"/* {inner} {DECOY} */"
    return inner


def code(rng):
    return rng.choice(["col", "$7", "$7$8", "name$with$dollars$", "x*y", "a / b", "1.5e3", "B'10'", "x - -1", ";"])


WHOLE = [literal, escaped, unicode_literal, identifier, dollar, line_comment, nested_comment, code]


@pytest.mark.parametrize("seed", range(250))
def test_only_the_last_comments_count(seed):
    """Whatever stands before, a trailing comment gives the tags; decoys in
    literals, identifiers, bodies and remarks never do."""
    rng = random.Random(seed)
    body = " ".join(["UPDATE t SET", *(rng.choice(WHOLE)(rng) for _ in range(rng.randrange(7))), "done"])
    value = rng.choice(["mail", "größe", "😀x", "a.b-c"])
    end = rng.choice(["", ";", " ; ", "\n;\n ;"])
    assert tags_of(f"{body} /*job:{value}*/{end}") == {"job": value}
    assert tags_of(f"{body} /*job:{value}*/ /*a remark*/{end}") == {"job": value}
    assert tags_of(f"{body}{end}") == {}
    assert tags_of(f"{body} /*job:{value}*/ more") == {}
    assert tags_of(f"/*job:{value}*/ {body}") == {}
    assert tags_of(f"/*job:{value}*/ {body}", extractors="marginalia(position=prepend)") == {"job": value}


@pytest.mark.parametrize("opened", ["'", '"', "$$", "$q$ $$", "E'\\'", "/* ", "/* /* */ ", "-- "])
def test_what_never_ends_hides_the_rest(opened):
    for before in ("SELECT 1 ", "SELECT 'x' /*job:early*/ "):
        assert tags_of(before + opened + DECOY) == {}


def test_backslashes_follow_the_setting():
    """With conforming strings a backslash is a character of a plain literal."""
    text = "VALUES ('c:\\') /*job:after*/"
    assert tags_of(text) == {"job": "after"} and tags_of(text, scs=False) == {}
    text = "VALUES ('c:\\'" + DECOY + "') /*job:after*/"
    assert tags_of(text, scs=False) == {"job": "after"}


def test_adjacent_literals_continue_in_escape_mode():
    assert tags_of("VALUES (E'one'\n  'two\\'" + DECOY + "') /*job:after*/") == {"job": "after"}


# ---- statements in one string ----
@pytest.mark.parametrize("seed", range(60))
def test_each_statement_has_its_own_comment(seed):
    rng = random.Random(seed)
    text, places = "", []
    for i in range(rng.randrange(1, 6)):
        own = f"UPDATE t{i} SET a = {literal(rng)} /*job:j{i}*/"
        lead = " " * rng.randrange(3)
        places.append((len((text + lead).encode()), len(own.encode()), f"j{i}"))
        text += lead + own + ";"
    for at, size, job in places:
        assert tags_of(text, at, size) == {"job": job}
    assert tags_of(text) == {"job": places[-1][2]}


def test_ranges_are_checked():
    text = "UPDATE t SET a = 1"
    n = len(text)
    for at, size in ((-2, 0), (n + 1, 0), (0, n + 1), (n - 1, 2), (0, -1)):
        with pytest.raises(ValueError, match="out of range"):
            tags_of(text, at, size)


def test_a_footer_serves_statements_without_a_comment():
    first, second = "INSERT INTO a VALUES (1)", "INSERT INTO b VALUES (2)"
    text = f"{first}; {second}; /*job:all*/"
    got = extract(Settings(), text, len(first) + 2, len(second))
    assert got["tags"] == {"job": "all"} and got["footer"]
    assert not extract(Settings(), text.replace(second, second + "/*job:own*/"), len(first) + 2, len(second) + 11)["footer"]
    assert tags_of(text, 0, len(first)) == {}  # not the last one
    assert tags_of(text + " SELECT 3", len(first) + 2, len(second)) == {}


def test_long_statements_are_read_from_their_ends():
    filler = " , " + "c" * 20
    got = extract(Settings(), "SELECT 0" + filler * 300 + " /*job:far*/")
    assert got["tags"] == {"job": "far"} and got["heuristic"] and got["heuristic_scans"] == 1
    assert not extract(Settings(), "SELECT 0" + filler * 10 + " /*job:near*/")["heuristic"]
    assert tags_of("/*job:front*/ SELECT 0" + filler * 300, extractors="marginalia(position=prepend)") == {"job": "front"}
    assert tags_of("SELECT 0 /*job:" + "v" * 90 + "*/", scan_window=64) == {}


def test_comment_limits():
    many = b"/*c*/" * 40
    assert len(lexer.scan_any(many, 0, len(many), True, 2048).spans) == 16 == len(lexer.scan_statement(many, 0, len(many), "append", 2048).spans)
    assert lexer.scan_any(b"/*one*/ /*two*/", 0, 15, True, 8).truncated


# ---- formats ----
@pytest.mark.parametrize("seed", range(80))
def test_quoted_pairs_round_trip(seed):
    """Percent-encoded pairs give their values back, in any order and spacing."""
    rng = random.Random(seed)
    want = {k: "".join(rng.choice("abc ,:='+%/é日😀") for _ in range(rng.randrange(1, 9))) for k in ("action", "controller", "job") if rng.random() < 0.8}
    space = lambda: " " * rng.randrange(2)
    items = [f"{space()}{k}{space()}={space()}'{quote(v, safe='')}'{space()}" for k, v in rng.sample(sorted(want.items()), len(want))]
    assert tags_of(f"SELECT 1 /*{','.join(items)}*/") == {k: v for k, v in want.items()}


@pytest.mark.parametrize("seed", range(80))
def test_plain_pairs_round_trip(seed):
    rng = random.Random(seed)
    want = {k: "".join(rng.choice("abc:=/é日.-") for _ in range(rng.randrange(1, 9))).strip().rstrip("/") for k in ("action", "controller", "job") if rng.random() < 0.8}
    items = [f"{' ' * rng.randrange(2)}{k}{' ' * rng.randrange(2)}:{v}" for k, v in want.items()] + ["other:ignored"] * rng.randrange(2)
    assert tags_of(f"SELECT 1 /*{rng.choice([',', ' , '])  .join(items)}*/", extractors="marginalia") == want


@pytest.mark.parametrize("bad", ["%00", "%FE", "%C3", "%ED%B0%80", "%F5%80%80%80"])
def test_values_that_are_no_text_are_invalid(bad):
    got = extract(Settings(), f"SELECT 1 /*action='{bad}',job='kept'*/")
    assert got["tags"] == {"job": "kept"} and got["invalid_tags"] == 1
    assert tags_of(f"SELECT 1 /*action='{bad}'*/", extractors="sqlcommenter(url_decode=off)") == {"action": bad}


def test_parsers_pass_over_what_is_malformed():
    got = extract(Settings(), "SELECT 1 /*action='a',nonsense,job='b'*/")
    assert got["tags"] == {"action": "a", "job": "b"} and got["invalid_tags"] == 1
    assert pairs.sqlcommenter(b"k='v',l='never closed").malformed >= 1
    assert pairs.marginalia(b"k->v", b"->", b">").malformed == 2
    assert pairs.decode(b"%g0%1", True) == b"%g0%1"


def test_other_separators_and_patterns():
    assert tags_of("SELECT 1 /*job=>mail;action=>send*/", extractors="marginalia(kv_sep='=>', pair_sep=';')") == {"action": "send", "job": "mail"}
    r = dict(extractors=r"regex(pattern='task <(\w+)>(?: by (\w+))?', keys=job|action)")
    assert tags_of("SELECT 1 /* task <mail> by cron */", **r) == {"action": "cron", "job": "mail"}
    assert tags_of("SELECT 'task <no>' /* task <mail> */ /* task <late> */", **r) == {"job": "mail"}
    assert tags_of("SELECT 'task <no> by x'", **r) == {}


def test_extractors_in_turn():
    """The first that finds pairs wins; one that merges adds what is missing."""
    text = "SELECT 1 /*job:plain,action:plain*/ /*job='quoted'*/"
    assert tags_of(text) == {"job": "quoted"}
    assert tags_of(text, extractors="sqlcommenter, marginalia(merge=on)") == {"action": "plain", "job": "quoted"}
    assert tags_of(text, extractors="marginalia, sqlcommenter(merge=on)")["job"] != "quoted"


# ---- keys and limits ----
def test_keys_renames_and_lists():
    text = "SELECT 1 /*svc:billing,op:charge,traceparent:00-1,request_id:9*/"
    assert tags_of(text, extractors="marginalia(rename=svc:service)", tags="service, op") == {"op": "charge", "service": "billing"}
    assert tags_of(text, extractors="marginalia(keys=op)", tags="*") == {"op": "charge"}
    assert tags_of(text, tags="*") == {"op": "charge", "svc": "billing"}
    assert set(tags_of(text, tags="*", exclude_tags="svc")) == {"op", "traceparent", "request_id"}
    limit = dsl.MAX_KEY
    got = extract(Settings(tags="*"), f"SELECT 1 /*{'a' * limit}:in,{'b' * (limit + 1)}:out*/")
    assert got["tags"] == {"a" * limit: "in"} and got["invalid_tags"] == 1


def test_what_does_not_fit_is_dropped():
    """By the order of the list; a smaller tag after it may still fit."""
    text = f"SELECT 1 /*p:1,q:{'x' * 60},r:{'y' * 63},s:2*/"
    got = extract(Settings(tags="q, r, s, p", max_tagset_bytes=128), text)
    assert got["tags"] == {"p": "1", "q": "x" * 60, "s": "2"} and got["dropped_tags"] == 1
    got = extract(Settings(tags="s, p, q", max_tags=2), text)
    assert got["tags"] == {"p": "1", "s": "2"} and got["dropped_tags"] == 1
    assert tags_of(f"SELECT 1 /*job:{'é' * 40}*/") == {"job": "é" * 32}  # 64 bytes, whole characters


@pytest.mark.parametrize("seed", range(60))
def test_rules_replace_all_matches_in_turn(seed):
    """Against the standard library on the subset that both dialects share."""
    rng = random.Random(seed)
    value = "/".join("".join(rng.choice("ab12") for _ in range(rng.randrange(1, 4))) for _ in range(3))
    steps = rng.sample([(r"\d+", "N"), ("[ab]+", r"<\&>"), (r"(\w)(\d)", r"\2\1"), ("x*", "-"), ("/", "::"), ("^.", "")], 2)
    want = value
    for pattern, replacement in steps:
        want = re.sub(pattern, replacement.replace(r"\&", r"\g<0>"), want, flags=re.ASCII)
    got = extract(Settings(tags="path", normalize=", ".join(f"path: '{p}' => '{r}'" for p, r in steps)), f"SELECT 1 /*path:{value}*/")
    assert got["tags"] == {"path": want} and got["normalized_tags"] == int(want != value)


def test_rule_quoting_and_length():
    assert tags_of("SELECT 1 /*job='a%27b'*/", normalize="'job': 'a''b' => '''=>, '") == {"job": "'=>, "}
    assert tags_of("SELECT 1 /*job:" + "j" * 50 + "*/", normalize="job: 'j' => 'éé'") == {"job": "é" * 32}


RULE = ["path", "path:", "path: 'x'", "path: 'x' => ", "path: x => 'y'", "path: 'x' => 'y',", ": 'x' => 'y'", "two words: 'x' => 'y'", "path: '' => 'y'", "path: '[' => 'y'", r"path: '(x)\1' => 'y'", r"path: 'x' => '\1'", r"path: 'x' => '\n'", "k" * (dsl.MAX_KEY + 1) + ": 'x' => 'y'"]


@pytest.mark.parametrize("bad", [*RULE, ", ".join(["path: 'x' => 'y'"] * (dsl.MAX_RULES + 1)), f"path: 'x' => '{'y' * (dsl.MAX_PATTERN + 1)}'"])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        dsl.parse_normalize(bad)


PARAMETERS = {"sqlcommenter": ["kv_sep=x", "pattern=x", "url_decode=perhaps"], "marginalia": ["url_decode=on", "kv_sep=" + "x" * 9, "pair_sep=''", "position=inside", "merge=2", "keys=", "rename=a", "rename=a:b|a:c", "keys=a, keys=a"], "regex": ["keys=a", "pattern='(x)'", "pattern='(x)(y)', keys=a", "pattern=')', keys=a"], "appname": ["", "format=xml", "format=marginalia, position=append"]}


@pytest.mark.parametrize("bad", [f"{name}({p})" for name, many in PARAMETERS.items() for p in many] + ["csv", "marginalia,", "marginalia marginalia", ",".join(["regex(pattern='(x)', keys=a)"] * (dsl.MAX_EXTRACTORS + 1)), "appname"])
def test_bad_extractors(bad):
    with pytest.raises(ValueError):
        dsl.parse_extractors(bad)


def test_lists_and_caps():
    assert dsl.parse_tag_list("two, one ,two") == ("two", "one") and dsl.parse_tag_list(" * ", star=True) == ("*",)
    assert dsl.parse_caps("job:3, a:b:0") == {"job": 3, "a:b": 0}
    for parse, bad in ((dsl.parse_caps, "job"), (dsl.parse_caps, "job:many"), (dsl.parse_caps, "job:1,job:1"), (dsl.parse_caps, "job:1000001"), (dsl.parse_tag_list, "job, *"), (dsl.parse_override, "job=mail")):
        with pytest.raises(ValueError):
            parse(bad)
    assert dsl.parse_override("job='m%20l',action='x'") == [(b"job", b"m l"), (b"action", b"x")]


def test_settings():
    s = Settings.parse(bucket_interval="2h", scan_window="1kB", reclaim_worker_interval="1s", exemplar_memory="512kB")
    assert (s.bucket_interval, s.scan_window, s.reclaim_worker_interval, s.exemplar_memory) == (7200, 1024, 1.0, 512 << 10)
    for bad in (dict(untagged="maybe"), dict(max_entries=1), dict(bucket_count=0), dict(tags="two words")):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_session_tags_and_precedence():
    """A comment beats the session's name, an override beats both."""
    s = Settings(extractors="sqlcommenter, appname(format=marginalia)")
    run = lambda q, **m: extract(s, q, **m)["tags"]
    name = b"job:worker,action:loop"
    assert run("SELECT 1", appname=name) == {"action": "loop", "job": "worker"}
    assert run("SELECT 1 /*job='call'*/", appname=name) == {"action": "loop", "job": "call"}
    assert run("SELECT 1 /*job='call'*/", appname=name, override=b"job='set'")["job"] == "set"


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [("a|ab", "ab", "ab"), ("(a|ab)(c|bcd)", "abcd", "abcd"), ("/(v|v1|v12)", "/v12/", "/v12"), ("[|a]+", "a|a", "a|a"), ("cat|dog", "hotdog", "dog"), (r"\|+", "||", "||"), ("[0-9]+|[0-9a-f]+", "12ab", "12ab")],
)
def test_the_longest_alternative_counts(pattern, text, want):
    assert dsl.compile_pattern(pattern).search(text).group() == want


def test_alternatives_beside_non_greedy_quantifiers():
    with pytest.raises(ValueError, match="non-greedy"):
        dsl.compile_pattern("(a|ab)+?c")
    assert dsl.compile_pattern("a+?b").search("aab").group() == "aab"
