"""Operator 3 on sentences that neither its trees nor its thresholds have seen."""

from __future__ import annotations

from ledgerloom.llm import pii

UNSEEN = [
    ("Drop a line to mary.ott (at) inbox (dot) com whenever you like", [("email", "mary.ott (at) inbox (dot) com")]),
    ("my mail: peter_k [at] bahnhof [dot] se", [("email", "peter_k [at] bahnhof [dot] se")]),
    ("Kontakt unter buero(at)tischlerei-lang.de möglich", [("email", "buero(at)tischlerei-lang.de")]),
    ("Escriba a ventas at zapatos dot es por favor", [("email", "ventas at zapatos dot es")]),
    ("envoyez un mail à claire {at} atelier {dot} fr", [("email", "claire {at} atelier {dot} fr")]),
    ("please phone (617) 555-0143 tomorrow", [("phone", "(617) 555-0143")]),
    ("his mobile, 503-555-0161, is off", [("phone", "503-555-0161")]),
    ("Telefon 0043 650 123 4567 ab neun", [("phone", "0043 650 123 4567")]),
    ("llama al teléfono 0034 699 100 200", [("phone", "0034 699 100 200")]),
    ("téléphone : 04 91 22 33 44", [("phone", "04 91 22 33 44")]),
    ("fax 312.555.0170 or post", [("phone", "312.555.0170")]),
    ("bill my card 4000.0566.5566.5556 again", [("card", "4000.0566.5566.5556")]),
    ("Karte 5200/8282/8282/8210 wurde belastet", [("card", "5200/8282/8282/8210")]),
    ("visa 4917_6100_0000_0000 declined", [("card", "4917_6100_0000_0000")]),
    ("host 2001:db8::ff00:42:8329 is down", [("ip", "2001:db8::ff00:42:8329")]),
    ("traffic from 10[.]20[.]30[.]40 was dropped", [("ip", "10[.]20[.]30[.]40")]),
    ("l'adresse 172(.)16(.)254(.)1 répond", [("ip", "172(.)16(.)254(.)1")]),
    ("We met at spark.apache.org in spring.", []),
    ("He stays at home. Nothing changed.", []),
    ("shop at market.de at eight", []),
    ("chapter 3 1122 3344 of 1999 2001 2003 2005", []),
    ("10.000.000 20.000.000 und 30.000.000", []),
    ("In 1871 1918 1933 1949 war es anders.", []),
    ("invoice 4711-000815-2022 of 01/02/2022", []),
    ("00:1A:2B:3C:4D:5E is its address", []),
    ("version 4.18.0.477 of the tool", []),
    ("rows 100-120, 340-360", []),
    ("le budget de 12 500 000 euros en 2015", []),
    ("Serial 9876 5432 1098 7654 of the motor", []),
    ("from 08:15:30 to 09:45:00", []),
]


def test_precision_and_recall_of_added_spans():
    model, limits = pii.train()
    assert all(0 < v < 1 and v != 0.5 for v in limits.values())
    found = wrong = real = 0
    for text, truth in UNSEEN:
        more = pii.added_spans(text, pii.base_spans(text), model, limits)
        got = {(k, text[s:e].strip()) for k in pii.KINDS for s, e in more[k]}
        found, wrong, real = found + len(got & set(truth)), wrong + len(got - set(truth)), real + len(truth)
    assert found >= 0.8 * real and wrong <= 0.1 * found


def test_known_look_alikes_and_long_names():
    model, limits = pii.train()
    more = lambda t: [(t[s:e], k) for k, v in pii.added_spans(t, pii.base_spans(t), model, limits).items() for s, e in v]
    for text in ("meet at example.com at noon", "chapter 12 3456 7890 of 2019 2020 2021 2022", "10.000.000 20.000.000"):
        assert more(text) == []
    name = "a" * 90
    assert more(f"write to {name} (at) posteo (dot) de now") == [(f"{name} (at) posteo (dot) de", "email")]
