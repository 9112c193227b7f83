"""Sentences in plain use, none from the test data: how much of the personal information in them is found."""

from quaystone.llm.pii import find_pii

PLAIN = [
    ("My colleague John Smith will call you back.", [("person", "John Smith")]),
    ("Please reach Maria Lopez or Ahmed Hassan before noon.", [("person", "Maria Lopez"), ("person", "Ahmed Hassan")]),
    ("Thank you for your help.\n\nSincerely,\nJane Doe", [("person", "Jane Doe")]),
    ("Kind regards,\nTomasz Kowalski\nAccounts", [("person", "Tomasz Kowalski")]),
    ("From: Peter Novak <p.novak@office.example>\nTo: Ines Marques <ines@office.example>", [("person", "Peter Novak"), ("person", "Ines Marques"), ("email", "p.novak@office.example"), ("email", "ines@office.example")]),
    ("Her name is Emily Carter and she works nights.", [("person", "Emily Carter")]),
    ("I met with Dr. Priya Raman on Tuesday.", [("person", "Priya Raman")]),
    ("Mr. Oliver Grant wrote to us twice.", [("person", "Oliver Grant")]),
    ("On behalf of Lena Fischer I ask for a refund.", [("person", "Lena Fischer")]),
    ("The form was signed by Noah Bennett yesterday.", [("person", "Noah Bennett")]),
    ("Sophie Turner said the lift was broken.", [("person", "Sophie Turner")]),
    ("My neighbour Carlos Ortega saw it too.", [("person", "Carlos Ortega")]),
    ("Mijn naam is Bart Willems en ik wacht nog steeds.", [("person", "Bart Willems")]),
    ("Met vriendelijke groeten,\nAnnelies Claes", [("person", "Annelies Claes")]),
    ("Mijn collega Sven Aerts komt morgen langs.", [("person", "Sven Aerts")]),
    ("Naam: Fatima El Amrani", [("person", "Fatima El Amrani")]),
    ("Je m'appelle Claire Fontaine.", [("person", "Claire Fontaine")]),
    ("Cordialement,\nHugo Lefèvre", [("person", "Hugo Lefèvre")]),
    ("Veuillez contacter Amélie Roux ou Karim Benali.", [("person", "Amélie Roux"), ("person", "Karim Benali")]),
    ("Monsieur Paul Girard a demandé un duplicata.", [("person", "Paul Girard")]),
    ("Ich heiße Katrin Vogel.", [("person", "Katrin Vogel")]),
    ("Mit freundlichen Grüßen\nJonas Becker", [("person", "Jonas Becker")]),
    ("Unsere Kollegin Heike Brandt meldet sich.", [("person", "Heike Brandt")]),
    ("Frau Dr. Miriam Engel ist zuständig.", [("person", "Miriam Engel")]),
    ("Yesterday Daniel Craigson missed his connection.", [("person", "Daniel Craigson")]),
    ("A parcel for Ruth Adeyemi is still here.", [("person", "Ruth Adeyemi")]),
    ("L'enfant de Marc Dupont a perdu son sac.", [("person", "Marc Dupont")]),
    ("Send it to Via Roma 12, 00184 Roma.", [("address", "Via Roma 12, 00184 Roma")]),
    ("Vive en Calle de Alcalá 45, 28014 Madrid.", [("address", "Calle de Alcalá 45, 28014 Madrid")]),
    ("Ship to 221B Baker Street, London NW1 6XE please.", [("address", "221B Baker Street, London NW1 6XE")]),
    ("Woont ze nog op Kerkstraat 9, 2000 Antwerpen?", [("address", "Kerkstraat 9, 2000 Antwerpen")]),
    ("Adres: Molenhoek 17 bus 2, 3500 Hasselt", [("address", "Molenhoek 17 bus 2, 3500 Hasselt")]),
    ("Il habite 8 rue des Lilas, 75020 Paris.", [("address", "8 rue des Lilas, 75020 Paris")]),
    ("Sie wohnt Am Sandtorkai 5, 20457 Hamburg.", [("address", "Am Sandtorkai 5, 20457 Hamburg")]),
    ("Our flat is at Flat 6, 18 Maple Avenue, Leeds LS6 2AB.", [("address", "Flat 6, 18 Maple Avenue, Leeds LS6 2AB")]),
    ("Address: Ridgeholme 4, 1000 Brussels", [("address", "Ridgeholme 4, 1000 Brussels")]),
    ("Call me on 555-867-5309 after six.", [("phone", "555-867-5309")]),
    ("Phone: (415) 555-0132 ext. 7", [("phone", "(415) 555-0132 ext. 7")]),
    ("Reach us at +49 30 901820 or 0030 210 3279100.", [("phone", "+49 30 901820"), ("phone", "0030 210 3279100")]),
    ("Bel 02 555 12 34 voor hulp.", [("phone", "02 555 12 34")]),
    ("Appelez le 01.42.68.53.00 ce soir.", [("phone", "01.42.68.53.00")]),
    ("SSN 123-45-6789 was on the form.", [("id_number", "123-45-6789")]),
    ("Passport no. X1234567 was found.", [("id_number", "X1234567")]),
    ("Rijksregisternummer: 93.05.18-223.61", [("id_number", "93.05.18-223.61")]),
    ("Write to first.last+tag@mail.example.org or help (at) shop (dot) example.", [("email", "first.last+tag@mail.example.org"), ("email", "help (at) shop (dot) example")]),
]
NOTHING = [
    "The Main Street corner was closed on 12/08/2026 at 10:45.",
    "Order 4512 778 was shipped, invoice 0467012116346 follows.",
    "Platform 4, coach 12, seat 45: the Night Mail left at 22:10.",
    "Version 9.18.46-549 of the Control Room manual replaces 9.17.",
    "De markt van 2026 was drukker dan die van 2025.",
    "Am Montag fährt der Zug um 12 Uhr ab Gleis 4.",
    "ISBN 978-3-16-148410-0 and part number 555-867-5309-1.",
    "The score was 3-2, attendance 41 500.",
]


def test_recall_on_plain_sentences():
    wanted = found = 0
    wrong = []
    for text, cases in PLAIN:
        got = {(k, text[a:b]) for a, b, k in find_pii(text)}
        wanted += len(cases)
        found += len(got & set(cases))
        wrong += [(text, x) for x in got - set(cases)]
    assert found / wanted >= 0.9, (found, wanted)
    assert len(wrong) <= 3, wrong


def test_plain_sentences_without_any():
    assert [(t, found) for t in NOTHING if (found := [(k, t[a:b]) for a, b, k in find_pii(t)])] == []


def test_an_account_is_one_unit():
    text = "Refund to IBAN BE71 0961 2345 6769, or card 4111 1111 1111 1111."
    assert [(k, text[a:b]) for a, b, k in find_pii(text)] == [("account", "BE71 0961 2345 6769"), ("account", "4111 1111 1111 1111")]
    assert find_pii("IBAN BE72 0961 2345 6769") == []  # the check digits do not hold
    assert find_pii("pay GB82WEST12345698765432 now")[0][2] == "account"


def test_cues_reach_over_any_distance():
    name = "Ada Lovelace"
    for blanks in (1, 50, 500):
        gap = " " * blanks
        assert ("phone", "0470123456") in {(k, t[a:b]) for t in [f"tel:{gap}0470123456"] for a, b, k in find_pii(t)}
        assert find_pii(f"invoice:{gap}0470123456") == []
        assert ("id_number", "592123456711") not in find_pii(f"card{gap}592123456711")
        assert [k for _, _, k in find_pii(f"passport no.{gap}XX123456")] == ["id_number"]
        assert [k for _, _, k in find_pii(f"We spoke with{gap}{name}.")] == ["person"]
    long_name = "Maria " + " ".join(f"{c}." for c in "ABCDEFGHIJKLMNOP") + " Lopez"
    text = f"Signed: {long_name}"
    assert [(k, text[a:b]) for a, b, k in find_pii(text)] == [("person", long_name)]
    text = "e" * 60 + " at depot " + "x" * 90 + " dot example"
    assert [k for _, _, k in find_pii("mail a.b at " + "x" * 100 + " dot example")] == ["email"]
