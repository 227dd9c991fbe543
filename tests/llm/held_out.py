"""Texts written by hand for measuring the tagger: none of these carriers and values stands in the training code; most layouts can be made by it."""

CARRIERS = {
    "email": ["If the export breaks again, drop {} a line.", "Kindly add {} to the distribution list before Thursday.", "{} has been bouncing since the migration.", "The invoice went to {}, which nobody reads.", "Die Rechnung ging an {} und kam zurück.", "On m'a dit d'utiliser {} pour les réclamations.", "La factura se mandó a {} por error.", "Can you check whether {} is still subscribed?"],
    "phone": ["The landlord picks up at {} most evenings.", "Try the night desk, {}, if the door is locked.", "{} goes straight to voicemail.", "He scribbled {} on a napkin.", "Der Hausmeister ist unter {} zu sprechen.", "Le gardien répond au {} jusqu'à minuit.", "El portero contesta en el {} por la noche.", "Her old number, {}, belongs to a bakery now."],
    "id_number": ["The notary copied {} from her passport.", "Benefits are paid under social security number {} since May.", "His tax number {} was rejected twice.", "Please scan the identity card, number {}, on both sides.", "Auf dem Personalausweis steht {} oben rechts.", "Le passeport {} a été perdu à Lyon.", "El DNI {} figura en el contrato.", "Her SSN, {}, was leaked in the breach."],
    "street_address": ["The movers unloaded everything at {} by mistake.", "A fire alarm went off in {} overnight.", "She inherited a flat in {}.", "The meter at {} has not been read for years.", "Der Umzugswagen steht vor {}.", "Le colis attend au {} depuis lundi.", "El taxi nos dejó en {} a las ocho.", "The clinic has reopened at {}, opposite the school."],
    "person_name": ["The jury praised {} for the rescue.", "{} burst into tears during the call.", "Nobody has seen {} since the retreat.", "The lease is in the name of {}.", "Die Enkelin von {} hat das Konto geerbt.", "La voisine de {} a gardé les clés.", "El primo de {} arregló la caldera.", "It was {} who noticed the leak."],
}
VALUES = {
    "email": ["gudrun.pfeiffer@posteo.example", "t.okonkwo92@northlake.org", "billing-team@kite-surfers.net", "marta_ruiz@correo.ejemplo.es", "h.vandermeer+lists@zeeland.nl", "sales at brightpaper dot com", "nils[at]fjordhus.no", "QUENTIN.ROY@ATELIER-BOIS.FR"],
    "phone": ["(312) 555-0148", "+49 171 2345678", "020 7946 0958", "06 12 34 56 78", "+34 612 345 678", "415.555.0132", "+1 202 555 0175", "0043 1 5880030"],
    "id_number": ["078-05-1120", "C01X00T47", "12345678Z", "AB 12 34 56 C", "X4927182", "PA0940443", "219-09-9999", "Y1234567X"],
    "street_address": ["221B Baker Street", "1600 Pennsylvania Avenue", "Lindenallee 14", "Hauptstraße 5, 79098 Freiburg", "12 rue de Rivoli, 75004 Paris", "Calle de Alcalá 48, 28014 Madrid", "742 Evergreen Terrace, Springfield", "10 Downing St"],
    "person_name": ["Beatrix Kühnel", "Rosalind Achebe", "T. Vandermolen", "Ludovic Perrin", "Concepción Ibarra", "Mr. Hargreaves", "Yevgenia Morozova", "Desmond"],
}
PLAIN = ["The kettle in the kitchen has been broken since 2019.", "We counted 48 chairs, 12 tables and 3 lamps.", "The Granite planner restarted on its own at 04:17.", "Please rerun stage 7 with a batch of 512 rows.", "Der Drucker im dritten Stock braucht Papier.", "Version 3.11.4 of the compiler dropped the flag.", "Le train de 18 h 42 aura du retard.", "La reunión se mueve a la sala 204.", "Set timeout=30 and retries=5 in config.yaml.", "Our summary agent skipped 14 of the 90 pages.", "Temperatures between 12 and 19 degrees are normal.", "git revert 9fceb02 and deploy again.", "Use the @cached decorator on slow calls.", "A street in the old town was closed for repairs.", "The passport office opens at nine.", "Row 1044 of the sheet has a wrong date, 2021-03-09.", "Her phone was stolen on the bus.", "The Copper Lantern tool exports to PDF.", "An index of 300000 vectors fits in memory.", "Send the report by email tomorrow."]


def texts() -> list[tuple[str, set[str]]]:
    """(text, kinds): each value in each carrier, and texts without personal data."""
    held = [(c.format(v), {k}) for k in CARRIERS for c in CARRIERS[k] for v in VALUES[k]]
    return held + [(t, set()) for t in PLAIN]


def measure(find) -> dict[str, tuple[float, float, int]]:
    """{kind: (recall, precision, extra)} of ``find``, which gives the kinds of each of a list of texts."""
    data = texts()
    got = find([t for t, _ in data])
    out = {}
    for k in CARRIERS:
        hit = sum(k in g and k in w for g, (_, w) in zip(got, data))
        extra = sum(k in g and k not in w for g, (_, w) in zip(got, data))
        out[k] = hit / sum(k in w for _, w in data), hit / max(1, hit + extra), extra
    return out
