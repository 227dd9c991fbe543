"""Labelled spans to train the tagger on: made-up personal data in composed and in real surroundings.

``python -m mnemospark.llm.labelled DATA_FOLDER OUT.npz`` fits the tagger that is kept beside this module. Values come
from public layouts and from random ones; names, towns and streets are made of sounds and of common name elements.
Nothing that surrounds a value is fixed: it is composed of fragments, or the value is spliced into sentences of at most
``rows`` messages and previews of the folder, of which only those are used that hold nothing rare.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from .tagger import LABELS, Tagger, spans, train

EMAIL, PHONE, ID, ADDRESS, NAME = range(1, 6)

# Common names in four languages, elements of family names and towns, words for streets, public suffixes.
GIVEN = "James Mary John Linda Robert Susan Michael Karen David Nancy Emily Oliver Sophie Lucas Anna Peter Laura Thomas Julia Martin Sabine Jürgen Heike Wolfgang Ute Pierre Camille Élodie François Hélène Jérôme Margaux José María Lucía Andrés Carmen Íñigo Pilar Raúl Priya Rahul Wei Mei Yuki Kenji Fatima Omar Ingrid Lars Olga Ivan Chiara Marco Niamh Sean Zofia Tomasz".split()
SURNAME = "Smith Johnson Brown Taylor Wilson Clark Walker Hughes Turner Schmidt Müller Fischer Weber Becker Schäfer Koch Martin Bernard Dubois Moreau Lefèvre García Fernández López Sánchez Romero Muñoz Patel Singh Chen Wang Tanaka Sato Rossi Bianchi Novak Kowalski Hansen Larsen Ivanov Okafor Nguyen Kim O'Brien McDonald Costa Silva".split()
STEMS = "ash oak elm birch thorn stone hill black white green north west fox hawk wolf lamb mill well brook marsh wood heath clay flint sand frost snow rain storm bell gold silver iron king abbot knight long hart swan crow rose lin eich berg wald stein linden bach haupt kloster garten sonnen".split()
TAILS = "son sen ton ley leigh ford wood worth ham bury dale shaw wick stead bridge gate burn brook hurst croft moor field well man mann berg stein bach hauser meier ez era oso ado ini etti elli ski ska ová ic escu eau ard in ault ier court mont".split()
TOWNS = "ville burg ton ford port mouth haven stadt dorf hausen furt heim hafen court mont bourg sur-Mer alba rio nova".split()
STREETS = "Street Str St St. Road Rd Rd. Lane Ln Ln. Avenue Ave Av. Drive Dr Dr. Court Ct Boulevard Blvd Terrace Way Place Pl Square Sq Close Crescent Row Hill Park Gardens Parkway Highway Walk Mews Grove Circle Trail".split()
GERMAN = "straße str. strasse weg allee platz gasse ring ufer damm steig".split()
TOPS = "com org net io dev info edu gov eu de fr es uk co.uk ch at it nl se mx com.ar ca in example test invalid local".split()
TITLES = "Mr. Mr Ms. Ms Mrs. Mrs Dr. Dr Prof. Professor Herr Frau Herrn Monsieur Madame M. Mme Señor Señora Sr. Sra. Don Doña Sir".split()

# Fragments that surroundings are composed of, {} being the place.
LEAD = {
    EMAIL: ["e-mail", "mail", "address", "inbox", "my mail address", "reach me via", "drop a note at", "answer goes to", "sent by", "registered as", "account", "login", "user", "notify", "invite", "subscribe", "bcc", "recipient", "sender", "schreib mir unter", "Postfach", "erreichbar per", "Kontakt", "courriel", "écris-moi à", "joindre", "correo", "escribe a", "escríbeme a", "escríbele a", "envíalo a", "contacto", "buzón", "the ticket came in from", "he can be mailed under", "forwarded by", "hosted for"],
    PHONE: ["phone", "tel", "telephone", "mobile", "cell", "call me on", "ring me at", "hotline", "office line", "direct line", "reachable under", "number", "WhatsApp", "contact number", "fax", "my new number", "Telefon", "Handy", "ruf mich an:", "Durchwahl", "erreichbar unter", "téléphone", "portable", "appelle-moi au", "numéro", "teléfono", "móvil", "llama al", "marca el", "pager", "she picks up on", "callback requested at", "SMS to", "leave a voicemail under", "hold the line on"],
    ID: ["id", "ID number", "document", "document no.", "identity card", "ID card", "passport", "passport no.", "passport number", "national ID", "social security number", "social security", "SSN", "tax ID", "tax number", "TIN", "taxpayer number", "insurance number", "NI number", "Ausweis", "Ausweisnummer", "Ausweisnr.", "Personalausweis", "Reisepass", "Steuer-ID", "Steuernummer", "Kennung", "carte d'identité", "passeport", "numéro fiscal", "numéro de sécu", "DNI", "NIE", "NIF", "pasaporte", "documento", "número de identidad", "identified by", "he showed", "the clerk noted", "copied from the papers:", "proof of identity", "it reads", "her papers say", "printed there"],
    ADDRESS: ["address", "home address", "lives at", "resides at", "office at", "deliver to", "delivery to", "delivery:", "pickup at", "Lieferung in die", "Abholung:", "livraison au", "retrait au", "entrega en", "recogida en", "shipping to", "billing address", "located at", "find us at", "parcel for", "we are at", "moved into", "invoice to", "come by", "meet in front of", "house on", "Anschrift", "Adresse", "wohnt in der", "wohnhaft in", "ansässig in", "zieht nach", "Paket an", "adresse postale", "habite au", "livrer au", "rendez-vous au", "dirección", "domicilio", "reside en", "enviar a", "nos vemos en", "the flat at", "parked outside", "keys left at", "courier goes to", "born and raised at"],
    NAME: ["by", "from", "with", "for", "according to", "signed by", "written by", "author", "contact", "dear", "hi", "hello", "regards,", "cheers,", "yours,", "reviewer", "owner", "customer", "on behalf of", "says", "cc", "attn.", "von", "mit", "laut", "für", "Hallo", "Liebe", "Gruß,", "Kollegin", "par", "avec", "selon", "pour", "Bonjour", "chez", "de parte de", "con", "según", "para", "Hola", "saludos,", "my manager", "the engineer", "our lawyer", "a colleague named", "patient", "interview with", "met", "thank", "ask", "phone call with", "wait for", "I am", "I'm", "this is", "call me", "name", "Name", "nombre", "nom"],
}
TAIL = {
    EMAIL: ["bounced", "is full", "works best", "gets the summary", "was removed", "has no access", "wants a copy", "antwortet nicht", "reçoit tout", "no responde", "signed up", "unsubscribed"],
    PHONE: ["after six", "rings out", "is busy", "any time", "in the evening", "was disconnected", "geht nicht ran", "le matin", "por la tarde", "and ask for support", "on weekdays", "has changed"],
    ID: ["expired", "was verified", "is on the copy", "belongs to her", "as shown on it", "matches the scan", "was typed twice", "ist abgelaufen", "est valable", "ya venció", "is the one they want", "appears in the file"],
    ADDRESS: ["second floor", "ring twice", "next to the bakery", "is where it happened", "until Friday", "im Hinterhof", "au fond", "al lado del parque", "has no lift", "is for sale", "burned down", "near the station"],
    NAME: ["wrote", "asked", "replied", "agreed", "left early", "is on leave", "called back", "resigned", "reviewed it", "wants a refund", "found the bug", "will present", "refused", "paid", "said no", "was promoted", "hat zugestimmt", "fragt nach", "ist krank", "a répondu", "est d'accord", "propose mardi", "ha llamado", "no viene", "lo revisó", "and her team", "and I talked", "joined on Monday", "has the keys", "knows more", "decides", "takes over"],
}
OPEN = ["", "", "", "", "Also, ", "Note: ", "FYI ", "- ", "* ", "> ", "1) ", "Bitte: ", "NB : ", "Ojo: ", "The ", "My ", "Their ", "New ", "Update: ", "P.S. ", "so ", "and ", "Yes, ", "OK, "]
SHUT = ["", ".", ".", ".", "!", "?", ";", ",", " please.", " thanks", " bitte.", " merci.", " gracias.", ", ok?", " (private)", " as agreed.", " today."]

# Fragments of text without personal data, and words to fill them; all of it is general.
THINGS = "batch shard block segment offset rack zone lot serial part order invoice row slot range sector build job run queue page chunk frame token port bucket partition lease epoch node pod disk tenant ticket step lane route drive court way place square road street avenue card number code key table field".split()
WORDS = "loader parser writer mirror proxy daemon client kernel buffer cursor vector matrix lookup digest report ledger metric window stream filter packet schema commit branch merge socket thread layout plugin module widget canvas prompt answer memory search planner router agent tool model".split()
CAPS = "Aurora Comet Nebula Pioneer Voyager Titan Delta Omega Phoenix Raven Granite Cobalt Amber Crystal Ember Zephyr Horizon Pilot Scout Ranger Nova Pulse Echo Spark Flux Nimbus Cargo Bridge Tower Garden Harbor River Copper Silver Compass Beacon".split()
CITIES = "London Paris Berlin Madrid Rome Vienna Lisbon Dublin Oslo Geneva Milan Nantes Toulouse Hamburg Munich Köln Dresden Sevilla Bilbao Granada Boston Chicago Seattle Denver Toronto Tokyo Osaka Mumbai Cairo Lima".split()
ROLES = "agent tool service model plugin bot product planner router assistant engine dashboard team module cluster release pipeline connector sandbox".split()
PLAIN = [
    "{T} {g} holds {n} rows", "{t} {g} was skipped", "the {w} reads {t} {g}", "version {n}.{n}.{n} fixes it", "{w} {n}.{n}.{n}-rc{n} is out", "host 10.{n}.{n}.{n} timed out", "ping 192.168.{n}.{n}:{n}", "took {n}.{n} s of {n} s", "on 20{m}-{m}-{m} at {m}:{m}", "{m}/{m}/20{m} {m}:{m}:{m}", "20{m}-{m}-{m}T{m}:{m}:{m}Z", "timestamp {e} in ms", "at {e} the {w} began",
    "sha {x} matches", "commit {x}", "trace {x}-{x}", "uuid {x}-{y}-{y}-{y}-{x}{y}", "{w}({n}, {n}) gave {n}", "{w}[{n}:{n}] of {n}", "$.{w}.{w}[{n}]", "/{w}/{w}/{n}.json", "https://{w}.{w}/{w}?{w}={n}", "{w}.{w}({w}={n})", "see {w}.py line {n}", "{n} of {n} done, {n}% left", "ratio {n}.{g}", "scores: {n}.{n}, {n}.{n}, {n}.{n}", "between {n} and {n} {t}s", "{n}x{n} px", "{n} + {n} = {n}", "error {n}: {w} {w} failed", "code E{n}, exit {n}", "{w}@v{n} was tagged", "pin {w}@v{n}.{n}", "{w}@latest is broken", "{w}@main and {w}@{x}", "{T} {q}-{q}-{q} is {w}", "{t} {q}-{q} of {q}", "{q}, {q} or {q}", "at {m} h {m} the {w} stops", "around {m}h{m}", "due 20{m}-{m}-{m}", "20{m}-{m}-{m}", "{m}.{m}.20{m}", "in {P}", "the {P} office", "moved from {P} to {P}", "à {P}", "en {P}", "nach {P} und {P}", "{P} is sunny", "flights to {P}", "a server in {P}", "pip install {w}=={n}.{n}", "npm i {w}@{n}.{n}.{n}", "annotate it with @{w}", "ping @{w} in the channel", "{w}@{w} is a job key", "handle @{w}_{w}", "{w}:{n}/{w}", "ticket {K}-{n}", "ISO {n}-{n}", "RFC {n}", "model {C}-{n}",
    "the {C} {C} {R} is slow", "the {C} {R} answered", "{C} {C} is our new product", "ask the {C} {R}", "sent to the {C} {C} {R}", "by the {C} {R}", "{C} ships in {n} days", "the {w} signed off", "von dem {C} {R}", "avec le {R} {C}", "con el {R} {C}", "{R} {C} approved {n} requests", "the {C} {C} release", "handed from the {w} to the {w}", "the {w} said no", "our {C} {C} {R} decides", "{C} {n} and {C} {n}", "try {C} {C} {R} first", "{C}, {C} and {C} are tools", "dear {w}, stop", "call the {w} with {n} rows", "call {w} again", "call depth {n}", "mail step off", "no e-mail was given", "phone field is empty", "the passport check is a stub", "address of the {w}: {x}", "tax rules changed", "id {n} of {n}", "the {w} id is {n}", "name the {w} first", "the address book is empty", "a street map of {n} tiles", "{n} steps on the way", "main road map, part {n}", "drive {n} is full", "court date moved", "at place {n} in the list", "step {n} of lane {n}", "the {t} {w} {n}", "{t} {n} {t} {n}", "{n} {w} {t}", "{n} {w}s on {t} {n}", "{n} {C} {w}s", "{P}, {P} and {P}", "{N} {w} {w}", "{N} am {T}", "das {N} und die {N}", "{N}: {n}", "{w} {t}, {w} {n}", "best regards", "kind regards from the {R}", "dot product of {n} dots", "look at {w} dot {w}", "at {n} dot {n}", "meet at {m}:{m}", "arrived at {w}", "wait {n} ms at {w} {n}", "den {w} prüfen", "der {C} {R} läuft", "le {w} a {n} lignes", "el {w} tiene {n} filas", "max {n}, min {n}, mean {n}.{n}", "{n}, {n}, {n}, {n}", "{K}{K} stays empty", "{K}{n} and {K}{n}", "[{n}] {W}: {w} {w}", "{W} {W} {W}", "{w} -> {w} -> {w}", "{w} = {n}; {w} = {n}", "§ {n}.{n}", "#{n}", "~{n}k tokens", "${n}.{m} a month", "€ {n},{m}",
]

# Parts of sentences about anything: who, what is done, to what, when; what is done to a person; German nouns are compounds.
SPEECH = {
    "en": ("the neighbour|our teacher|my aunt|the driver|a nurse|the mayor|her brother|his boss|the baker|two guests|the choir|a tenant|the referee|the gardener|my cousin|the bride|the committee|a tourist|the plumber|everyone|somebody|the director|an old friend|their coach", "painted|sold|forgot|carried|repaired|opened|locked|photographed|borrowed|returned|washed|described|lost|found|counted|ordered|cancelled|moved|cleaned|inspected", "the boat|a blue jacket|the last ticket|our fence|the piano|some flowers|a heavy suitcase|the broken window|the cake|his bicycle|the garden|a letter|the bill|the old map|the roof|three chairs", "in March|before dinner|again|last week|at the market|during the storm|without a word|on Sunday|for the third time|near the lake|in a hurry|by accident|after the concert|this morning", "met|hired|visited|thanked|remembers|trusts|admired|invited|called|blamed|followed|married|saw|heard|elected|helped|warned|praised|asked|missed|sued|congratulated"),
    "de": ("die Nachbarin|unser Lehrer|meine Tante|der Fahrer|eine Ärztin|der Bürgermeister|ihr Bruder|sein Chef|der Bäcker|zwei Gäste|der Chor|die Mieterin|jemand|der Gärtner|die Kusine|der Ausschuss|ein Tourist|der Trainer", "hat gestrichen|verkauft|vergisst|trägt|repariert|öffnet|sucht|fotografiert|bringt|wäscht|beschreibt|zählt|bestellt|putzt|prüft|holt", "das Boot|eine blaue Jacke|die letzte Karte|unseren Zaun|das Klavier|ein paar Blumen|den Koffer|das Fenster|den Kuchen|sein Fahrrad|den Garten|einen Brief|die Rechnung|das Dach", "im März|vor dem Essen|wieder|letzte Woche|auf dem Markt|im Sturm|ohne ein Wort|am Sonntag|am See|aus Versehen|nach dem Konzert|heute früh", "traf|besucht|kennt|dankt|vertraut|lobt|ruft|sah|hörte|wählte|heiratet|vermisst|fragt|verklagt"),
    "fr": ("la voisine|notre professeur|ma tante|le chauffeur|une infirmière|le maire|son frère|son patron|le boulanger|deux invités|la chorale|un locataire|quelqu'un|le jardinier|ma cousine|le comité|un touriste", "a peint|vend|oublie|porte|répare|ouvre|ferme|emprunte|rend|lave|décrit|perd|trouve|compte|commande|déplace", "le bateau|une veste bleue|le dernier billet|notre clôture|le piano|des fleurs|la valise|la fenêtre|le gâteau|son vélo|le jardin|une lettre|la facture|le toit", "en mars|avant le dîner|encore|la semaine dernière|au marché|sans un mot|dimanche|près du lac|par accident|après le concert|ce matin", "a vu|connaît|remercie|admire|invite|appelle|suit|écoute|épouse|cherche|félicite"),
    "es": ("la vecina|nuestro profesor|mi tía|el chófer|una enfermera|el alcalde|su hermano|su jefe|el panadero|dos invitados|el coro|un inquilino|alguien|el jardinero|mi prima|el comité|un turista", "pintó|vende|olvida|lleva|repara|abre|cierra|pide|devuelve|lava|describe|pierde|encuentra|cuenta|mueve", "el barco|una chaqueta azul|la última entrada|nuestra valla|el piano|unas flores|la maleta|la ventana|el pastel|su bicicleta|el jardín|una carta|la factura|el tejado", "en marzo|antes de cenar|otra vez|la semana pasada|en el mercado|sin decir nada|el domingo|junto al lago|por error|tras el concierto|esta mañana", "vio a|conoce a|agradece a|admira a|invitó a|llamó a|sigue a|oyó a|busca a|felicitó a"),
}
SPEECH = {k: [x.split("|") for x in v] for k, v in SPEECH.items()}
BEFORE = {
    "en": {EMAIL: "at|to|via|from|using", PHONE: "at|on|under|by calling|from", ID: "with passport|under the ID|using ID card|with tax number|with social security number", ADDRESS: "at|in|near|to|from|in front of|opposite|behind", NAME: "with|for|to|from|by|of|and|like|without|because of"},
    "de": {EMAIL: "an|unter|von|per", PHONE: "unter|von|auf", ID: "mit Pass|mit Ausweis|mit der Steuernummer|unter der Ausweisnummer", ADDRESS: "in der|in|vor|nach|am|gegenüber", NAME: "mit|für|von|bei|und|ohne|wegen"},
    "fr": {EMAIL: "à|via|par|de", PHONE: "au|sur le|par le", ID: "avec le passeport|sous le numéro fiscal|avec la carte d'identité", ADDRESS: "au|à|devant le|près du|du", NAME: "avec|pour|de|chez|par|et|sans"},
    "es": {EMAIL: "a|por|desde|con", PHONE: "al|en el|desde el", ID: "con el pasaporte|con el DNI|bajo el número fiscal", ADDRESS: "en|a|desde|frente a|cerca de", NAME: "con|para|de|por|y|sin"},
}
BEFORE = {k: {n: x.split("|") for n, x in v.items()} for k, v in BEFORE.items()}
COMPOUND = "Haus Wasser Arbeit Zeit Wagen Bahn Hof Schrank Garten Fenster Licht Kosten Papier Schule Markt Winter Brief Kasten Platz Holz Küchen Büro Dienst Reise Konto Zimmer Tür Nacht Sommer Werk Bild Stadt Land Feld Post Eis".split()


class Maker:
    """Made-up personal data, from a seeded generator; ``given`` and ``family`` are mixed in with composed names."""

    def __init__(self, seed: int, given: list[str] = (), family: list[str] = ()):
        self.r, self.given, self.family_names = random.Random(seed), list(given), list(family)

    def one(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def digits(self, n: int) -> str:
        return str(self.r.randrange(10**n)).zfill(n)

    def sound(self, least: int, most: int) -> str:
        """A made-up word of syllables."""
        out = ""
        for _ in range(self.r.randint(least, most)):
            out += self.one(["", "b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "br", "ch", "cl", "dr", "fr", "gr", "kr", "ph", "pr", "qu", "sh", "st", "th", "tr", "x", "y", "sch", "ll", "ñ"]) + self.one("aaaeeeeiiioouu" + "áéíóüöäyèø") + self.one(["", "", "", "", "l", "n", "r", "s", "m", "th", "nd", "rt", "ss", "ck", "k", "x"])
        return out

    def first(self) -> str:
        x = self.r.random()
        if self.given and x < 0.2:
            return self.one(self.given)
        if x < 0.4:
            return self.one(GIVEN)
        if x < 0.5:
            return (self.one(STEMS) + self.one(["a", "ia", "e", "us", "ina", "elle", "an"])).capitalize()
        return (self.sound(1, 3) + self.one(["", "a", "o", "ia", "us", "e", "ne", "la", "n", "is"])).capitalize()

    def last(self) -> str:
        x = self.r.random()
        if self.family_names and x < 0.2:
            return self.one(self.family_names)
        if x < 0.35:
            return self.one(SURNAME)
        if x < 0.65:
            return (self.one(STEMS) + self.one(TAILS)).capitalize()
        out = (self.sound(1, 2) + (self.one(TAILS) if x < 0.9 else "")).capitalize()
        return self.one(["Mc", "O'", "de ", "van ", "von ", "da ", "De", "al-", "Le "]) + out if x > 0.96 else out

    def cap(self) -> str:
        """A name of a product or of an agent."""
        return self.one(CAPS) if self.chance(0.6) else (self.one(STEMS) + self.one(["", "", *TAILS])).capitalize() if self.chance(0.5) else self.sound(2, 3).capitalize()

    def name(self) -> str:
        f, g, r = self.first(), self.last(), self.r.random()
        initial = self.one("ABCDEFGHIJKLMNOPRSTUVWZ")
        if r < 0.36:
            out = f"{f} {g}"
        elif r < 0.44:
            out = f"{g}, {f}"
        elif r < 0.55:
            out = f
        elif r < 0.62:
            out = g
        elif r < 0.70:
            out = f"{f} {initial}. {g}"
        elif r < 0.74:
            out = f"{f} {g}-{self.last()}"
        elif r < 0.78:
            out = f"{f}-{self.first()} {g}"
        elif r < 0.82:
            out = f"{f} {g} {self.last()}"
        elif r < 0.86:
            out = f"{initial}. {g}"
        elif r < 0.88:
            out = f"{f} {initial}."
        else:
            out = self.one(TITLES) + " " + (g if self.chance(0.6) else f"{f} {g}")
        r = self.r.random()
        return out.lower() if r < 0.1 else out.upper() if r < 0.14 else out

    def plain_word(self) -> str:
        return self.one(STEMS) if self.chance(0.3) else self.one(WORDS) if self.chance(0.3) else re.sub(r"[^a-z]", "", self.sound(1, 3)) or "a"

    def email(self) -> str:
        letters = lambda s: re.sub(r"[^a-z]", "", s.lower()) or "q"
        f, g = letters(self.first()), letters(self.last())
        user = self.one([f, g, f + g, f"{f}.{g}", f"{g}.{f}", f"{f}_{g}", f"{f}-{g}", f"{f[0]}.{g}", f"{f[0]}{g}", f"{f}{g[0]}", f"{f}{self.digits(self.r.randint(1, 4))}", f"{f}.{g}{self.digits(2)}", f"{f}.{g}+{self.plain_word()}", f"{self.plain_word()}.{self.plain_word()}", self.plain_word()])
        host = self.plain_word() + self.one(["", "", "", "-", "."]) + (self.plain_word() if self.chance(0.6) else "")
        host = (host.strip("-.") or "q") + "." + self.one(TOPS)
        r = self.r.random()
        at, dot = ("@", ".") if r < 0.68 else (" at ", " dot ") if r < 0.84 else (self.one(["[at]", "(at)", " [at] ", " (at) ", " AT ", " @ "]), self.one([".", "[dot]", "(dot)", " dot ", " [dot] ", " (dot) ", " DOT "]))
        # the dots of a spelled-out host are spelled out, those of the user at times
        out = (user.replace(".", dot) if dot != "." and self.chance(0.3) else user) + at + host.replace(".", dot)
        return out.upper() if self.chance(0.06) else out

    def groups(self, total: int, sep: str) -> str:
        out, left = [], total
        while left:
            n = min(left, self.r.randint(2, 4))
            n = left if left - n == 1 and left <= 5 else n
            out.append(self.digits(n))
            left -= n
        return sep.join(out)

    def phone(self) -> str:
        d, sep = self.digits, self.one([" ", " ", "-", "-", ".", "/", ""])
        r = self.r.random()
        area = self.one("23456789") + d(2)
        if r < 0.36:
            out = self.one([f"{area}.{d(3)}.{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area}{sep or '-'}{d(3)}{sep or '-'}{d(4)}", f"({area}) {d(3)}-{d(4)}", f"({area}){d(3)}-{d(4)}", f"1-{area}-{d(3)}-{d(4)}", f"{area}-{d(7)}", f"{area}/{d(7)}"])
        elif r < 0.56:
            out = self.one([f"0{d(2)}{sep or ' '}{d(4)}{sep or ' '}{d(4)}", f"0{d(4)} {d(6)}", f"0{d(3)}/{d(7)}", f"0{d(2)} {d(7)}", f"0{d(1)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", f"(0{d(3)}) {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}{sep or '.'}{d(2)}{sep or '.'}{d(2)}{sep or '.'}{d(2)}{sep or '.'}{d(2)}", f"0{d(2)}-{d(8)}", f"0{d(10)}"])
        elif r < 0.66:
            out = self.one([f"{self.one('679')}{d(2)}{sep or ' '}{d(3)}{sep or ' '}{d(3)}", f"{self.one('679')}{d(2)} {d(2)} {d(2)} {d(2)}"])
        else:
            code = self.one(["+", "+", "+", "+", "+", "00"]) + self.one(["1", "44", "49", "33", "34", "39", "41", "43", "52", "351", "61", "91", str(self.r.randint(20, 998))])
            body = self.groups(self.r.choice([8, 9, 9, 10, 10]), sep)
            out = code + self.one([" ", " ", sep, sep, " (0)", "-"]) + body
            if self.chance(0.15):
                out = f"{code} ({d(3)}) {self.groups(7, sep or '-')}"
        if self.chance(0.1):
            out += self.one([" ext. ", " ext ", " x", " Ext. "]) + d(self.r.randint(2, 4))
        return "tel:" + re.sub(r"[ ()/]", "", out) if self.chance(0.04) else out

    def id_number(self) -> str:
        """A number by its layout alone: an American, British or other public one, or letters and digits at random."""
        d, u = self.digits, lambda n: "".join(self.one("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
        r = self.r.random()
        if r < 0.25:
            s = self.one(["-", "-", "-", " "])
            return f"{d(3)}{s}{d(2)}{s}{d(4)}"
        if r < 0.37:
            s = self.one([" ", " ", "", "-"])
            return f"{u(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{self.one('ABCD')}"
        if r < 0.45:
            return self.one([f"{d(8)}{s}{u(1)}" for s in ("", "-")] + [f"{self.one('XYZ')}{s}{d(7)}{s}{u(1)}" for s in ("", "-")])
        if r < 0.9:
            return u(self.one([1, 1, 2, 2, 3])) + self.one(["", "", "", " "]) + d(self.r.randint(6, 9)) + (u(1) if self.chance(0.35) else "")
        return f"{u(1)}{self.digits(2)}{u(1)}{self.digits(2)}{u(1)}{self.digits(2)}"

    def said_number(self) -> tuple[str, str]:
        """What goes before a number that is told by this only, and the number."""
        d = self.digits
        lead = self.one([x for x in LEAD[ID] if x not in ("id", "it reads", "printed there", "identified by", "he showed", "document")])
        s = self.one([" ", " ", " ", "-", "-", ""])
        number = self.one([self.id_number(), d(9), d(11), d(10), d(12), s.join([d(2), d(3), d(3), d(3)]), s.join([d(4), d(4), d(4)]), "-".join([d(4), d(4), d(4)]), s.join([d(1), d(2), d(2), d(2), d(3), d(3), d(2)]), s.join([d(3), d(3), d(3)]), s.join([d(3), d(4), d(4)]), f"{d(3)}/{d(3)}/{d(5)}", f"{d(2)}-{d(7)}"])
        return lead, number

    def town(self) -> str:
        out = (self.one(STEMS) if self.chance(0.5) else self.sound(1, 2)) + self.one(["", *TOWNS, *TAILS])
        return self.one(["", "", "", "", "San ", "New ", "Bad ", "Saint-", "Port ", "Upper ", "La ", "East "]) + out.capitalize()

    def address(self) -> str:
        d = lambda n: str(self.r.randrange(1, 10**n))
        n = d(self.one([1, 2, 2, 3, 3, 4, 4])) + (self.one("abcABC") if self.chance(0.12) else "")
        x = self.one([lambda: self.one(STEMS).capitalize(), lambda: self.last(), lambda: self.one(CAPS), lambda: f"{self.one(['Old', 'North', 'Upper', 'Saint', 'Great', 'Low'])} {self.one(STEMS).capitalize()}", lambda: self.one(STEMS).capitalize() + self.one(["'s", "s", "s'"]), lambda: self.one(GIVEN), lambda: self.sound(2, 3).capitalize(), lambda: self.one(["First", "Second", "5th", "12th", "Main", "High", "Church", "Station", "Park", "Bridge", "Market"])])()
        z, town, r = self.digits(5), self.town(), self.r.random()
        if r < 0.46:
            out = f"{n} {x} {self.one(STREETS)}"
            if self.chance(0.12):
                out = self.one([f"Flat {d(2)}, ", f"Unit {d(2)}, ", f"Apt {d(2)}, ", f"Suite {d(3)}, "]) + out
            if self.chance(0.35):
                out += self.one([f", Apt {d(2)}", f", Apt {d(2)}{self.one('ABC')}", f", Apt. {d(2)}{self.one('ABC')}", f" #{d(2)}", f", Suite {d(3)}", f", Floor {d(1)}", f", Unit {d(2)}"])
            if self.chance(0.45):
                out += self.one([f", {town}", f", {town} {z}", f", {town}, {self.one(['CA', 'NY', 'TX', 'OR', 'WA'])} {z}", f", {town} {self.one('BCEGLMNS')}{d(1)} {d(1)}{self.one('ABDEH')}{self.one('ABDEH')}"])
        elif r < 0.7:
            y = self.one(GERMAN)
            street = self.one([f"{x.replace(' ', '-')}{y}", f"{self.one(COMPOUND + STEMS).capitalize()}{self.one(['', 'n', 'en'])}{y}", f"{x} {y.capitalize()}", f"{self.one(['Am', 'An der', 'Im', 'Alter', 'Zum'])} {x}{self.one(['', y])}"])
            out = f"{street} {n}" + (self.one([f", {z} {town}", f" in {z} {town}", f", {town}"]) if self.chance(0.5) else "")
        elif r < 0.85:
            y = self.one(["rue", "rue", "avenue", "boulevard", "chemin", "place", "allée", "impasse", "quai", "cours"])
            out = n + self.one(["", "", " bis", " ter"]) + self.one([" ", ", "]) + y + self.one([" de ", " de la ", " du ", " des ", " "]) + x + (f", {z} {town}" if self.chance(0.4) else "")
        else:
            y = self.one(["Calle", "Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Ronda"])
            out = f"{y} {self.one(['', '', 'de ', 'del ', 'de la ', 'San '])}{x}{self.one([' ', ', ', ', nº ', ' núm. '])}{n}" + (f", {d(1)}º {self.one(['A', 'B', 'izq.', 'dcha.'])}" if self.chance(0.25) else "") + (f", {z} {town}" if self.chance(0.35) else "")
        r = self.r.random()
        return out.lower() if r < 0.17 else out.upper() if r < 0.19 else out

    def plain(self) -> str:
        """A phrase without personal data."""
        r = self.r
        fill = {
            "n": lambda: str(r.randrange(10 ** r.choice([1, 2, 2, 3, 4]))), "m": lambda: self.digits(2), "e": lambda: "1" + self.digits(r.choice([9, 12])), "g": lambda: self.one([self.digits(r.randint(4, 9)), self.groups(r.choice([7, 9, 10, 12]), self.one("-.: "))]) if self.chance(0.7) else "-".join(self.digits(4) for _ in range(3)),
            "q": lambda: str(r.randint(1000, 9999)) if self.chance(0.6) else str(2 ** r.randint(8, 13)), "N": self.noun, "P": lambda: self.one(CITIES) if self.chance(0.5) else self.town(),
            "x": lambda: f"{r.getrandbits(32):08x}"[: r.choice([6, 7, 8])], "y": lambda: f"{r.getrandbits(16):04x}", "w": lambda: self.one(WORDS) if self.chance(0.6) else self.one(THINGS), "W": lambda: self.one(WORDS).capitalize(), "t": lambda: self.one(THINGS), "T": lambda: self.one(THINGS).capitalize(), "C": self.cap, "R": lambda: self.one(ROLES), "K": lambda: self.one("ABCDEFGKPQRSTXZ") * r.choice([1, 2]),
        }
        out = re.sub(r"\{(\w)\}", lambda m: fill[m[1]](), self.one(PLAIN))
        return self.one(OPEN[:14]) + (out.capitalize() if self.chance(0.5) and out[0].islower() else out) + self.one(SHUT)

    def value(self, kind: int) -> tuple[str, str]:
        """What belongs right before the value, and the value."""
        if kind == ID and self.chance(0.5):
            lead, number = self.said_number()
            return lead + self.one([" ", " ", ": ", " is ", " no. ", "=", " # "]), number
        return "", (self.email, self.phone, self.id_number, self.address, self.name)[kind - 1]()

    def carrier(self, kind: int, around: list[str]) -> tuple[str, str]:
        """Text before and after a value: composed of fragments, cut out of real sentences, or next to nothing."""
        r = self.r.random()
        if r < 0.3:
            before, after = self.speech(kind).split("{}")
            return before, after
        if r < 0.6:
            lead, tail = (self.one(LEAD[kind]) if self.chance(0.7) else ""), (self.one(TAIL[kind]) if self.chance(0.5) else "")
            if lead and self.chance(0.5):
                lead = lead[0].upper() + lead[1:] if self.chance(0.85) else lead.upper()
            glue = self.one([" ", " ", " ", ": ", ": ", " is ", " = ", "=", " - ", "\n"]) if lead else ""
            before = self.one(OPEN) + (self.words(around, 1, 5) + " " if self.chance(0.35) else "") + lead + glue
            after = (self.one([" ", " ", ", ", " - "]) + tail if tail else "") + (" " + self.words(around, 1, 6) if self.chance(0.35) else "") + self.one(SHUT)
            return before, after
        if r < 0.9:
            return (self.words(around, 1, 9) + " " if self.chance(0.85) else ""), (self.one([" ", " ", " ", ", ", ". ", ": ", "\n", " - ", "; "]) + self.words(around, 1, 9) if self.chance(0.8) else "") + self.one(SHUT)
        a, b = self.one([("", ""), ("<", ">"), ("(", ")"), ('"', '"'), ("| ", " |"), ("[", "]"), ("'", "'"), ("**", "**"), ("`", "`"), (f'"{self.plain_word()}": "', '",'), (f"{self.plain_word()}=", "&"), (f"{self.plain_word()}: ", "\n"), ("\n", "\n"), ("- ", "\n"), ("— ", "")])
        return a, b

    def noun(self) -> str:
        """A German compound."""
        return self.one(COMPOUND) + self.one(COMPOUND).lower() + self.one(["", "", "s", "en", "er", "ung"])

    def speech(self, hole: int = 0) -> str:
        """A sentence about anything, with {} in it where a value of the kind ``hole`` can stand."""
        tongue = self.one(["en", "en", "de", "fr", "es"])
        who, does, what, when, person = (self.one(x) for x in SPEECH[tongue])
        if tongue == "de" and self.chance(0.5):
            who, what = self.one(["der ", "die ", "das ", "kein "]) + self.noun(), self.one(["den ", "die ", "das ", "einen ", ""]) + self.noun()
        if hole == NAME and self.chance(0.6):
            out = self.one([f"{{}} {does} {what} {when}", f"{{}} {does} {what}", f"{who} {person} {{}}", f"{who} {person} {{}} {when}", f"{when} {{}} {does} {what}", f"{{}} {person} {who}", f"{{}} {when}", f"{{}}, {who}, {does} {what}"])
        elif hole:
            b = self.one(BEFORE[tongue][hole])
            out = self.one([f"{who} {does} {what} {b} {{}}", f"{who} {does} {what} {b} {{}} {when}", f"{b} {{}} {who} {does} {what}", f"{who} {b} {{}} {does} {what}", f"{{}}: {who} {does} {what}", f"{who}, {{}}, {does} {what}", f"{{}} {when}, {does} {who}", f"{what} {b} {{}}"])
        else:
            out = self.one([f"{who} {does} {what} {when}", f"{who} {does} {what}", f"{when}, {who} {does} {what}", f"{what} {when}", f"{who}, {what} {self.one(['and', 'und', 'et', 'y'])} {self.one(SPEECH[tongue][2])}", f"{who} {does} {self.digits(2)} {self.one(THINGS)}s {when}"])
        out += self.one([".", ".", ".", "", "!", "?"])
        return out[0].upper() + out[1:] if self.chance(0.8) else out

    def words(self, around: list[str], least: int, most: int) -> str:
        """Successive words of a real sentence, or of a made-up one."""
        r = self.r.random()
        got = (self.one(around) if r < 0.5 else self.speech() if r < 0.85 else self.plain()).split(" ")
        n = min(len(got), self.r.randint(least, most))
        at = self.r.randint(0, len(got) - n)
        return " ".join(got[at : at + n])

    def sample(self, around: list[str]) -> tuple[str, np.ndarray]:
        """One text with the label of each character; brackets, mailto: and what announces a number aren't part of it."""
        parts: list[tuple[str, list[int]]] = []
        for _ in range(self.one([0, 1, 1, 1, 2])):
            s = self.one(around) if self.chance(0.6) else self.speech()
            parts.append((s, [0] * len(s)))
        for _ in range(self.one([0, 0, 1, 1, 1, 2, 2, 3])):
            if self.chance(0.36):
                s = self.plain()
                parts.insert(self.r.randint(0, len(parts)), (s, [0] * len(s)))
                continue
            text, marks = "", []
            kinds = [self.one([EMAIL, PHONE, ID, ID, ADDRESS, ADDRESS, NAME, NAME, NAME])]
            if self.chance(0.15):
                kinds.append(self.one([EMAIL, PHONE, ID, ADDRESS, NAME]))
            before, after = self.carrier(kinds[0], around)
            text, marks = before, [0] * len(before)
            for j, kind in enumerate(kinds):
                lead, value = self.value(kind)
                if j:
                    lead = self.one([" ", ", ", " / ", " - ", " and ", "\n", "; "]) + lead
                if kind == EMAIL and self.chance(0.1):
                    lead += "mailto:"
                text, marks = text + lead + value, marks + [0] * len(lead) + [kind] * len(value)
            text, marks = text + after, marks + [0] * len(after)
            if self.chance(0.03):  # a sentence in lower case
                text = text.lower() if len(text.lower()) == len(text) else text
            parts.insert(self.r.randint(0, len(parts)), (text, marks))
        text, labels = "", []
        for s, y in parts:
            gap = "" if not text else self.one([" ", " ", " ", "\n"])
            text += gap + s
            labels += [0] * len(gap) + y
        if text and self.chance(0.12):
            cut = self.r.randint(len(text) // 2, len(text))
            text, labels = text[:cut] + "…", labels[:cut]
            n = next((i for i, y in enumerate(reversed(labels)) if not y), len(labels))
            if n < 5:  # too little is left to tell
                labels[len(labels) - n :] = [0] * n
            labels.append(0)
        return text, np.array(labels, np.int8)


def surroundings(texts: list[str], rare: int = 60) -> list[str]:
    """Sentences of the texts that hold only words and shapes found in at least ``rare`` of them."""
    count: Counter = Counter()
    for t in texts:
        count.update(set(re.findall(r"[^\W\d_]+", t)))
    ids = re.compile(r"\b[a-z]+-[0-9a-f]{5}\b")
    out = set()
    for t in texts:
        for s in re.split(r"(?<=[.!?])\s+|\n", t):
            plain = ids.sub("", s)
            if s and not re.search(r"@|\d{3}[^\s\d]+\d|\d \d|\d{6}| at .* dot ", plain) and all(count[w] >= rare for w in re.findall(r"[^\W\d_]+", plain)):
                out.add(s)
    return sorted(out)


def read_texts(folder: str, rows: int) -> list[str]:
    """At most ``rows`` messages and as many previews."""
    import pyarrow.parquet as pq

    out = []
    for table, column in (("messages", "content"), ("context_entries", "content_preview")):
        out += [x for x in pq.read_table(f"{folder}/{table}.parquet", columns=[column])[column].to_pylist()[:rows] if x]
    return out


def fit(folder: str, rows: int = 20_000, samples: int = 60_000, h: int = 20, epochs: int = 12, seconds: float = 1e9, start: Tagger | None = None, seed: int = 1) -> Tagger:
    """Train on made-up samples in surroundings of at most ``rows`` rows of each table; known names are some of the names."""
    import pyarrow.parquet as pq

    names = pq.read_table(f"{folder}/known_names.parquet").to_pylist()
    maker = Maker(seed, [n["name"] for n in names if n["name_type"] == "given"], [n["name"] for n in names if n["name_type"] == "family"])
    around = surroundings(read_texts(folder, rows))
    return train([maker.sample(around) for _ in range(samples)], h=h, epochs=epochs, seconds=seconds, start=start, seed=seed)


if __name__ == "__main__":
    model = fit(sys.argv[1], seconds=float(sys.argv[3]) if len(sys.argv) > 3 else 1e9, seed=int(sys.argv[4]) if len(sys.argv) > 4 else 1)
    model.save(Path(sys.argv[2]))
    check = Maker(99)
    right = wrong = 0
    tests = [check.sample(["Nothing here."]) for _ in range(2000)]
    for (_, y), got in zip(tests, model.tag([t for t, _ in tests])):
        a, b = {LABELS[s[2]] for s in spans(y)}, {LABELS[s[2]] for s in spans(got)}
        right, wrong = right + len(a & b), wrong + len(a ^ b)
    print(f"kinds of {len(tests)} unseen texts: {right} right, {wrong} wrong")
