import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.awkward import docs
from weftlink.llm.license_scan import ScanParams, automaton, scan_licenses, scan_text, words_of
from weftlink.llm.license_templates import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A = automaton(ScanParams())


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_places(text):
    w = WORD.findall(lower(text))
    return sorted((i, label) for p, label in PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


PIECES = ["mit", "License", "license", "apache", "general", "public", "GENERAL", "the", "licensed", "under", "été", "mit license", "gnu", "version", "3", "-", "x"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map(" ".join))
def test_phrase_places_and_matching_statistics(text):
    n, n_base, first, last, base, labels, score, spans = scan_text(text, A)
    want = brute_places(text)
    assert n == len(WORD.findall(lower(text))) and n_base == len(want)
    assert (first, last) == ((want[0][0], want[-1][0]) if want else (None, None))
    assert base == ",".join(sorted({x[1] for x in want})) and set(filter(None, base.split(","))) <= set(filter(None, labels.split(",")))
    assert 0 <= score <= 1
    words = words_of(text)
    runs, _ = A.matches(words)
    seqs = [words_of(t) for t in (*(t for _, t in TEMPLATES), *(p for p, _ in PHRASES))]
    held = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, min(len(s), i + 26) + 1)}
    longest = [(i, j) for i in range(len(words)) for j in range(i + 3, len(words) + 1) if tuple(words[i:j]) in held
               and not (i and tuple(words[i - 1:j]) in held) and not (j < len(words) and tuple(words[i:j + 1]) in held)]
    assert sorted((e - k + 1, e + 1) for e, k, _ in runs) == longest


def test_every_template_is_found_in_a_longer_text():
    for label, text in TEMPLATES:
        found = scan_text("some words before it. " + text + " and others after", A)
        assert label in found[5].split(",") and any(s["label"] == label and s["cover"] == 1 and s["first_word"] == 4 for s in found[7])
    assert scan_text("the license of the software is a matter of the public and the general use of it", A)[5] == ""


def test_awkward_documents(spark):
    got = scan_licenses(docs(spark)).collect()
    assert len(got) == 10 and all(r.labels == "" and r.score == 0 for r in got)
    assert scan_licenses(docs(spark, [])).collect() == []
    assert scan_licenses(docs(spark, [(None, "Apache license, MIT LICENSE", None, None)])).head().base_labels == "apache,mit"


def covers(text, a=A):
    return [(x["label"], x["first_word"], x["last_word"], x["cover"]) for x in scan_text(text, a)[7]]


def test_stray_matches_take_nothing_from_a_template():
    for label, text in TEMPLATES:
        n, words = len(words_of(text)), text.split()
        for at in {*range(0, len(words) - 3, 7), len(words) - 3}:
            stray = " ".join(words[at:at + 3])
            k = len(words_of(stray))
            assert (label, k + 1, k + n, 1) in [x for x in covers(f"{stray} zzz {text}")]
            if n < 30:  # halves of shorter ones are too short to chain
                continue
            half = len(words) // 2
            split = covers(" ".join([*words[:half], "zzz", stray, "zzz", *words[half:]]))
            assert any(x[0] == label and x[1] == 0 and x[2] == n + k + 1 and x[3] >= (n - 4) / n for x in split), (label, at, split)
    label, text = TEMPLATES[0]
    n = len(words_of(text))
    assert [x[1:] for x in covers(f"{text} zzz {text}") if x[0] == label] == [(0, n - 1, 1), (n + 1, 2 * n, 1)]


def brute_covers(runs, a, k):
    """The most that any chain of runs covers, from all chains."""
    nodes = sorted((end, t_end, length) for end, length, v in runs for t_end in a.states[v].ends.get(k, ()))

    def longest(i):
        end, t_end, length = nodes[i]
        best = length
        for j in range(i):
            last, t_last, _ = nodes[j]
            cut = max(0, last - end + length, t_last - t_end + length)
            if last < end and cut < length and end - length + cut - last <= a.params.max_gap and t_end - length + cut - t_last <= a.params.max_gap:
                best = max(best, longest(j) + length - cut)
        return best

    return max(map(longest, range(len(nodes))), default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdx"), max_size=14).map(" ".join))
def test_chains_cover_the_most_possible(text):
    a = automaton(ScanParams(templates=(("one", "a b c a b d a b c d"), ("two", "c d a b")), phrases=(("q r", "q"),), min_match=2, max_gap=2, cover=0.5))
    runs, _ = a.matches(words_of(text))
    spans = a.spans(runs)
    for k in (0, 1):
        best = brute_covers(runs, a, k) / a.lengths[k]
        assert max((s[3] for s in spans if s[0] == k), default=0) == (min(1, best) if best >= 0.5 else 0)
