import pytest

from quaystone.llm.pii import find_pii, mask, masked_texts, pii_stretches

CASES = [
    ("Contact: Mila Vandewalle <mila.vandewalle@post.example.test>.", {("person", "Mila Vandewalle"), ("email", "mila.vandewalle@post.example.test")}),
    ("Mail naar j.peeters+x (at) mail.example.nl of bel +32 (0)2 555 01 23.", {("email", "j.peeters+x (at) mail.example.nl"), ("phone", "+32 (0)2 555 01 23")}),
    ("write to info [at] depot [dot] be or ring (202) 555-0143 ext. 12.", {("email", "info [at] depot [dot] be"), ("phone", "(202) 555-0143 ext. 12")}),
    ("gsm 0470/12.34.56, mail A_B AT DEPOT DOT TEST", {("phone", "0470/12.34.56"), ("email", "A_B AT DEPOT DOT TEST")}),
    ("Dhr. van den Berg, Karel, kaart 592-1234567-11, Oude Molenstraat 12b bus 3, 9000 Gentbrugge.", {("person", "van den Berg, Karel"), ("id_number", "592-1234567-11"), ("address", "Oude Molenstraat 12b bus 3, 9000 Gentbrugge")}),
    ("Mme J. d'Haene est joignable au 04.65.71.00.11.", {("person", "J. d'Haene"), ("phone", "04.65.71.00.11")}),
    ("J'habite 12 bis, rue du Vieux-Pont, B-1000 Bruxelles et je prends le train.", {("address", "12 bis, rue du Vieux-Pont, B-1000 Bruxelles")}),
    ("Ich wohne Obere Mühlstraße 7 - D-52062 Aachen und fahre. Kontakt: VON DER HEIDE Anna (", {("address", "Obere Mühlstraße 7 - D-52062 Aachen"), ("person", "VON DER HEIDE Anna")}),
    ("I live at Flat 3, 14a St Mary's Close, Oxford OX1 2AB and take it.", {("address", "Flat 3, 14a St Mary's Close, Oxford OX1 2AB")}),
    ("Numéro national 85.07.30-033.28 relevé. Rijksregisternummer 85073003328 werd genoteerd.", {("id_number", "85.07.30-033.28"), ("id_number", "85073003328")}),
    ("M. Jan Maes, carte B 145 040466 74, rue Haute 221.", {("person", "Jan Maes"), ("id_number", "B 145 040466 74"), ("address", "rue Haute 221")}),
    ("J'habite Oude Lindenstr. 20 bus 1 et je prends le train.", {("address", "Oude Lindenstr. 20 bus 1")}),
    ("Terugbetaling naar Molenlaan 185-7/7, 9985 Aalst. Erstattung an Doktor-Koch-Straße 11a, D-52062 Aachen.", {("address", "Molenlaan 185-7/7, 9985 Aalst"), ("address", "Doktor-Koch-Straße 11a, D-52062 Aachen")}),
    ("lisa de wilde zag de slagboom openstaan.", {("person", "lisa de wilde")}),
    ("We spoke with Tom A. Reed and Okafor, Ada on the platform.", {("person", "Tom A. Reed"), ("person", "Okafor, Ada")}),
    ("Ping @control. Token 01018552805173 expired at 10:10. Reference 2646/140, 12/08/2026, version 9.18.46-549.", set()),
    ("Meet at the corner of the Stationsplein in Aalst. Spoorkring 83C, spoor 5, trein 4812.", set()),
    ("", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_stretches(text, want):
    assert {(k, text[a:b]) for a, b, k in find_pii(text)} == want


def test_mask_keeps_the_rest():
    assert mask("Signed: Ada Lovelace. Call +44 7700 900123 now") == "Signed: <PERSON>. Call <PHONE> now"
    assert mask(None) is None and mask("") == "" and mask("plain") == "plain"
    for text, want in CASES:
        left = mask(text)
        assert all(x not in left for _, x in want)


def test_long_and_broken_texts():
    find_pii("a" * 200_000)
    find_pii("1 " * 50_000)
    find_pii("Aa " * 30_000)
    find_pii(("Aa " * 40 + "zag ") * 2_000)
    find_pii("van de " * 20_000 + "zag ")
    find_pii(("Flat 3, " * 50 + "12 " + "Aa " * 6 + "Street ") * 300)
    assert find_pii("x " * 50_000 + "mail a.b@c.example")[-1][2] == "email"
    find_pii("Ã© \ud800 \u0000 " * 100)


def test_operators(spark):
    rows = [(1, "mail a.b@c.example and a.b@c.example", "k"), (1, "mail a.b@c.example", "k"), (2, None, "k"), (3, "", "k"), (None, "mail a.b@c.example", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_kind string")
    got = sorted((str(r.doc_id), r.pii_kind, r.pii_text) for r in pii_stretches(df).collect())
    assert got == [("1", "email", "a.b@c.example"), ("None", "email", "a.b@c.example")]
    assert masked_texts(df).count() == 5
    assert pii_stretches(spark.createDataFrame([], df.schema)).count() == 0
