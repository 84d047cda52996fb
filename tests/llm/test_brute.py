"""op4, op9 and op10 computed again in plain Python: candidates, features and votes; samples and predictions; pairs of draws."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import regex

from hitlake.llm import language_id, pieces, secrets
from hitlake.llm.common import ship

SF = "/root/testdata/sf0.01"


def plain_candidates(text):
    """(core, word, before2, before1, after1) of a text's candidates."""
    ws, out = re.split(secrets.GAP, text or ""), []
    at = lambda i: ws[i] if 0 <= i < len(ws) else ""
    for i, w in enumerate(ws):
        near = (at(i - 2), at(i - 1), at(i + 1))
        parts, runs = re.findall(secrets.GROUP, w) if re.search(secrets.RUN, w) else [], []
        for k, (gap, group) in enumerate(parts):
            name = re.search(secrets.NAME, (parts[k - 1][1] if k else "")[-40:] + gap[-80:])[1]
            own = ("", "", near[2]) if k and re.search("[=:]", name) else near
            for n, core in enumerate(group.split(".")):
                inner = re.match("[A-Za-z0-9_-]{1,40}=(?=[^=.])", group) if n else None
                word = w if len(parts) == 1 and "." not in group else name + (inner[0] if inner else "") + core
                runs.append((core, word, *own))
        values = []
        if re.search("[=:]$", near[1]) and re.search(secrets.LEFT, f"{near[0][-80:]} {near[1][-80:]}"):
            m = re.match(rf"{secrets.OPEN}({secrets.VALUE})", w)
            values.append((m[1] if m else "", w))
        values += [(m[1], m[0]) for m in re.finditer(secrets.INSIDE, w)]
        values = [(v.rstrip(".:"), word, *near) for v, word in values]
        values = [v for v in values if len(v[0]) >= 6 and re.search("[0-9]", v[0]) and re.search("[A-Za-z]", v[0]) and not re.search(secrets.RUNS_ONLY, v[0])]
        tail = lambda core: core.rsplit("=", 1)[-1] if "=" in core else ""
        out += [x for x in runs if not any(x[0] in v[0] or (tail(x[0]) and v[0].startswith(tail(x[0]))) for v in values)] + values
    return out


def plain_features(c, words):
    core, word, before2, before1, _ = c
    n = len(core)
    share = lambda p: len(re.findall(p, core)) / n
    name = re.match("([^=:]{0,40})[=:]", word)
    near = " ".join([before2, before1, name[1] if name else ""])
    key = "(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)"
    return [
        n, share("[0-9]"), share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"), share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        share("[aeiouAEIOU]"), len(set(core)) / n, 1 - len(re.sub(words, "", core.lower())) / n, bool(re.search("^(0x)?[0-9a-fA-F]+$", core)),
        len(re.findall(r"[/\\.]", word)), bool(re.search("@|://", word)), bool(re.search("[\"'`]", word)),
        bool(re.search("[=:]$", before1) or re.search("^[^=:]{1,40}[=:]", word)), bool(re.search(key, near)),
    ]


def plain_tree(tokens):
    """A printed CASE expression as a function of the features."""
    t = next(tokens)
    if t != "CASE":
        return lambda f: float(t)
    _, name, _, bound, _ = (next(tokens) for _ in range(5))
    yes, _, no, _ = plain_tree(tokens), next(tokens), plain_tree(tokens), next(tokens)
    return lambda f: yes(f) if f[int(name[2:-1])] <= float(bound[:-1]) else no(f)


def test_secrets_by_hand(spark):
    r = random.Random(5)
    odd = [
        "PASSWORD=hunter2!Xy9 is set", 'token = "s3cr3t" # no more', "db_password: p@ss,w0rd", "x=1&secret='ab12cd.'&y", "author: smith2020 wrote",
        "token: twelve", "auth_token=abc12 short", "api_key:   漢字ab12", "secret=" + "k9" * 20, "password = " + "q7" * 4 + "!" + "z" * 30, None, "", "= 12ab34cd",
    ]
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(10**6 + i, t) for i, t in enumerate(odd)] + [(2 * 10**6 + i, f"pwd={''.join(r.choices('abc123xyz9', k=9))} ok") for i in range(30)]
    df = base.union(spark.createDataFrame(more, "doc_id long, text string")).coalesce(2).persist()
    words = secrets.dictionary(df)
    cores = {10**6 + i: [c[0] for c in plain_candidates(t)] for i, t in enumerate(odd)}
    want = [["hunter2!Xy9"], ["s3cr3t"], [], ["ab12cd"], [], [], ["auth_token=abc12"], ["漢字ab12"], ["secret=" + "k9" * 20], ["q7" * 4 + "!" + "z" * 30]]
    assert [cores[10**6 + i] for i in range(10)] == want
    plain, labels = {}, set()
    for d in df.collect():
        plain[d.doc_id] = [(c[0], plain_features(c, words)) for c in plain_candidates(d.text)]
    for core, f in itertools.chain(*plain.values()):
        if f[12] and f[11] and 0.1 < f[1] < 0.95:
            labels.add((*map(float, f), 1.0))
        elif not f[12] and not f[11] and (f[9] or f[8] >= 2 or f[1] in (0, 1)):
            labels.add((*map(float, f), 0.0))
    found = secrets.findings(df, words)
    near = lambda rows: sorted(tuple(round(x, 12) for x in row) for row in rows)
    assert near({(*x.features, x.label) for x in found.collect()}) == near(labels) and {x[-1] for x in labels} == {0.0, 1.0}
    rule = secrets.forest(found)
    trees = [plain_tree(iter(t.split())) for t in rule[1 : rule.rindex(")")].split(" + ")]
    got = {x.doc_id: x for x in secrets.scan(df).collect()}
    assert got.keys() == plain.keys()
    for d in df.collect():
        votes = [(core, sum(t(f) for t in trees) / len(trees)) for core, f in plain[d.doc_id]]
        want = list(dict.fromkeys(core for core, v in votes if v > 0.5))
        x = got[d.doc_id]
        assert (x.n_candidates, x.secrets or []) == (len(votes), want)
        assert x.max_score == pytest.approx(max((v for _, v in votes), default=None)) if votes else x.max_score is None
        text = d.text
        for core in sorted(want, key=len, reverse=True):
            text = text.replace(core, secrets.MARK)
        assert x.redacted == text
    assert got[10**6].redacted == "PASSWORD=[SECRET] is set" and got[10**6 + 1].redacted == 'token = "[SECRET]" # no more'
    assert all(got[2 * 10**6 + i].redacted == "pwd=[SECRET] ok" for i in range(30))


def test_secrets_clashing_columns(spark):
    df = spark.createDataFrame([(1, "see abc", "kept", 7)], "`__0` long, text string, `__1` string, `__3` int")
    assert [tuple(x[c] for c in df.columns) for x in secrets.scan(df).collect()] == [(1, "see abc", "kept", 7)]


def test_language_by_hand(spark):
    import xxhash
    import zstandard as z

    ship(spark)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs, sample = df.collect(), {}
    for d in docs:
        if d.lang is None or d.text is None or language_id.crc_mod3(d.doc_id) == 1:
            continue
        h = xxhash.xxh64(d.text.encode(), seed=42).intdigest()
        h -= (h >> 63) << 64
        first = h % (max(len(d.text) - 1500, 0) + 1)
        piece = d.text[first : first + 1500]
        if regex.search(r"\p{L}", piece):
            sample.setdefault(d.lang, set()).add((len(d.text) < 200, h, piece))
    want = {k: " ".join(language_id.letters(x[2]) for x in sorted(v)[:200][::-1]).encode() for k, v in sample.items()}
    assert language_id.learn(df) == want and len(want) > 2
    tools = {}
    for k in sorted(want):
        p = z.ZstdCompressionParameters.from_level(3, window_log=19, write_content_size=0, write_checksum=0, write_dict_id=0)
        tools[k] = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(want[k], dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p)
    got = {x.doc_id: x for x in language_id.op9_language_id(df).collect()}
    assert got.keys() == {d.doc_id for d in docs}
    for d in random.Random(2).sample(docs, 150) + [d for d in docs if not regex.search(r"\p{L}", d.text or "")]:
        x = got[d.doc_id]
        if not regex.search(r"\p{L}", d.text or ""):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        raw = language_id.letters(d.text).encode()
        size = {k: sum(len(t.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)) for k, t in tools.items()}
        low, second = sorted(size.values())[:2]
        assert x.lang_pred == min(size, key=lambda k: (size[k], k)) and x.score == pytest.approx(min(1.0, 4 * (second - low) / second))


@pytest.mark.parametrize("text", ["the", "a be", "is\nso"])
def test_pairs_of_draws(text):
    """Two draws without replacement: each ordered pair as often as p(a) p(b) / (1 - p(a)) says, over all segmentations."""
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    v, sp = pieces.vocabulary(path, 0.5), sentencepiece.SentencePieceProcessor(model_file=path)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}

    def ways(s):
        if not s:
            return [()]
        return [(known[s[:k]], *rest) for k in range(1, len(s) + 1) if s[:k] in known for rest in ways(s[k:])]

    if "\n" in text:  # a newline has no piece of its own: its byte piece costs one byte weight
        head, tail = text.split("\n")
        nl = int(v.byte_ids[10])
        all_ = [(*a, nl, *b) for a in ways(pieces.SPACE + head) for b in ways(tail)]
        weight = {w: sum(float(v.weight[i]) if i != nl else v.byte_weight for i in w) for w in all_}
    else:
        all_ = [sum(x, ()) for x in itertools.product(*(ways(pieces.SPACE + t) for t in text.split(" ")))]
        weight = {w: float(v.weight[list(w)].sum()) for w in all_}
    total = sum(map(math.exp, weight.values()))
    p = {w: math.exp(x) / total for w, x in weight.items()}
    n, seen = 30000, {}
    got = pieces.sample_texts(v, [text] * n, np.arange(n, dtype="u8"), 2, 9)
    for g in got:
        a, b = (tuple(map(int, o["ids"])) for o in g)
        assert g[0]["log_prob"] == pytest.approx(math.log(p[a])) and g[0]["value"] > g[1]["value"] > g[0]["kappa"]
        seen[a, b] = seen.get((a, b), 0) + 1
    expect = {(a, b): n * p[a] * p[b] / (1 - p[a]) for a, b in itertools.permutations(all_, 2)}
    assert seen.keys() <= expect.keys() and len(all_) > 3
    often = {k: e for k, e in expect.items() if e >= 5}
    rest = n - sum(often.values())
    chi = sum((seen.get(k, 0) - e) ** 2 / e for k, e in often.items()) + (n - sum(seen.get(k, 0) for k in often) - rest) ** 2 / max(rest, 1)
    assert chi < len(often) + 5 * math.sqrt(2 * len(often)) + 5
