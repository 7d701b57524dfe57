"""Sentences with hand-made labels in four languages, for the thresholds of operator 3.

Each is (text, [(kind, value)]): all personal data in it that the contract's
patterns do not find. The others hold look-alikes only.
"""

from __future__ import annotations

SENTENCES: list[tuple[str, list[tuple[str, str]]]] = [
    ("You can write to anna.keller (at) posteo (dot) de until Friday.", [("email", "anna.keller (at) posteo (dot) de")]),
    ("My address is j_morris [at] fastmail [dot] com, not the old one.", [("email", "j_morris [at] fastmail [dot] com")]),
    ("contact: sales at widgetfactory dot co dot uk", [("email", "sales at widgetfactory dot co dot uk")]),
    ("Schreib bitte an k.weber at gmx dot de, danke.", [("email", "k.weber at gmx dot de")]),
    ("Escríbenos a info (at) casaverde (dot) es para reservar.", [("email", "info (at) casaverde (dot) es")]),
    ("Mon courriel : luc.martin [at] orange [dot] fr", [("email", "luc.martin [at] orange [dot] fr")]),
    ("reach me under tom {at} tomsbikes {dot} org", [("email", "tom {at} tomsbikes {dot} org")]),
    ("E-Mail: praxis(at)zahnarzt-mueller.de", [("email", "praxis(at)zahnarzt-mueller.de")]),
    ("Ring me on (212) 555-0187 after six.", [("phone", "(212) 555-0187")]),
    ("Call 415-555-0132 and ask for Dave.", [("phone", "415-555-0132")]),
    ("Telefon: 030 4567890, werktags bis 18 Uhr", [("phone", "030 4567890")]),
    ("Tel. 089/55512345 oder per Fax", [("phone", "089/55512345")]),
    ("Mi teléfono es 0034 612 345 678, llámame.", [("phone", "0034 612 345 678")]),
    ("Son numéro de téléphone est le 01 44 55 66 77.", [("phone", "01 44 55 66 77")]),
    ("Appelez le 06 12 34 56 78 le soir.", [("phone", "06 12 34 56 78")]),
    ("his cell is 646.555.0199 these days", [("phone", "646.555.0199")]),
    ("Fax: 0221 987654", [("phone", "0221 987654")]),
    ("My phone is 020 7946 0321.", [("phone", "020 7946 0321")]),
    ("Please charge my visa 4111.1111.1111.1111 for the room.", [("card", "4111.1111.1111.1111")]),
    ("Kreditkarte Mastercard 5500/0000/0000/0004 gültig bis Mai", [("card", "5500/0000/0000/0004")]),
    ("the card number was 4012_8888_8888_1881 and it worked", [("card", "4012_8888_8888_1881")]),
    ("Tarjeta: 5105.1051.0510.5100", [("card", "5105.1051.0510.5100")]),
    ("carte bancaire 4242/4242/4242/4242, merci", [("card", "4242/4242/4242/4242")]),
    ("pay with 6011  1111  1111  1117 today", [("card", "6011  1111  1111  1117")]),
    ("The server answers on 2001:db8:85a3::8a2e:370:7334 only.", [("ip", "2001:db8:85a3::8a2e:370:7334")]),
    ("login from fe80::1ff:fe23:4567:890a at night", [("ip", "fe80::1ff:fe23:4567:890a")]),
    ("block 203[.]0[.]113[.]9 at the firewall", [("ip", "203[.]0[.]113[.]9")]),
    ("Der Host 198[.]51[.]100[.]23 ist verdächtig.", [("ip", "198[.]51[.]100[.]23")]),
    ("adresse 192(.)0(.)2(.)44 du client", [("ip", "192(.)0(.)2(.)44")]),
    ("peer 2a02:8108:50bf:9a00:1c2d:3e4f:5061:7283 connected", [("ip", "2a02:8108:50bf:9a00:1c2d:3e4f:5061:7283")]),
    ("Let us meet at example.com at noon.", []),
    ("The talk at python.org was long.", []),
    ("She works at google.com now and likes it.", []),
    ("Look at page 4. Then go home.", []),
    ("He is good at chess. Nobody knows why.", []),
    ("Wir trafen uns at home. Danach gingen wir.", []),
    ("They sold it @ auction. Nobody bid.", []),
    ("Arrive at 10.30 or at 11.45 please.", []),
    ("See chapter 12 3456 7890 of 2019 2020 2021 2022 for more.", []),
    ("The years 1914 1918 1939 1945 changed Europe.", []),
    ("Der Umsatz stieg von 10.000.000 auf 20.000.000 Euro.", []),
    ("El presupuesto es de 1.250.000.000 pesos.", []),
    ("La population compte 67 413 000 habitants.", []),
    ("Invoice 2023-000451-7781 was paid.", []),
    ("ISBN 978-3-16-148410-0 is out of print.", []),
    ("Order no 4500017823 of item 100200300400", []),
    ("The meeting runs 09:30:00 to 10:45:30 on 12/05/2021.", []),
    ("MAC 00:1B:44:11:3A:B7 belongs to the printer.", []),
    ("Version 10.0.19045.3324 is installed.", []),
    ("Serial 1234 5678 9012 3456 of the pump", []),
    ("total 3.141.592 units, 2.718.281 sold", []),
    ("The ratio is 16:9:4 in all cases.", []),
    ("scores 1021 1187 1304 1422 were noted", []),
    ("On 24.12.2020 18.30 we ate.", []),
    ("Parcel 7711 2020 55 went to 80331 on 03/04/2022.", []),
    ("Konto 12345678 Bankleitzahl 70050000", []),
    ("Page 100-105, 220-228 and 300-310", []),
    ("It cost 1 299 000 in 2004 and 2 450 000 in 2014.", []),
    ("Psalm 119:105:3 and verse 12:4:5", []),
    ("ticket 555-1234-9876-11 closed, ref 20210304-11", []),
]
