"""Patterns and word lists on which results depend. Patterns are Java's, for Spark."""

from __future__ import annotations

IBAN = r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:[A-Z0-9]{4}\s){2,7}[A-Z0-9]{1,4})\b"
DATE = r"\b\d{2}-\d{2}-\d{4}\b"
AMOUNT = r"(?:(?:€|\$|£|¥|CHF|USD|EUR|GBP|SEK|NOK|DKK|kr\.?)\s*\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?|\d{1,3}(?:\.\d{3})*,\d{2}|\d{1,3}(?:,\d{3})*\.\d{2})\b"
#: The older feature set's amount (euro only) and IBAN (a space or hyphen anywhere).
EURO_AMOUNT = r"(?:€\s*)?\d{1,3}(?:\.\d{3})*(?:,\d{2})\b"
LOOSE_IBAN = r"\b[A-Z]{2}\d{2}(?:[ \-]?[A-Z0-9]){11,30}\b"

DUTCH_COMMON = "de het een en van in is dat op te voor met aan zijn worden door als naar uit over ook meer tot bij nog dan wel om of kan dit niet maar er al wat hebben was jaar zou gaan na zo ons die hier wordt".split()
ENGLISH_COMMON = "the a an is are was were be been have has had do does did will would could should may might must shall can to of and in for on with at by from or as but not this that it he she we they you i".split()
GARBAGE = (r"[#&][^a-zA-Z\s]{3,}", r"[+\-*/]{2,}", r"\d[#&%]\d")
SPECIAL = r"[&%$#@!^*+=<>|\\~`'\"/]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
OCR_ERRORS = (r"[^\x00-\x7F]", r"\d{10,}", r"[|@#$%^&*]{3,}")

DUTCH_STOP_WORDS = (
    "de het een die dat deze dit hij zij wij jullie hun haar hem mij jou ons hen wie wat welke welk "
    "van in op te aan met voor door over bij naar uit tot om onder tegen tussen zonder binnen buiten "
    "en of maar want dus omdat als dan toen terwijl hoewel indien tenzij zodra voordat nadat zodat "
    "is zijn was waren ben bent heeft hebben had hadden wordt worden werd werden kan kunnen kon konden zal "
    "zullen zou zouden moet moeten moest moesten mag mogen wil willen wilde wilden gaat gaan ging gingen komt "
    "komen kwam kwamen doet doen deed deden zegt zeggen "
    "niet ook nog wel al er hier daar waar hoe nu zo toch heel erg zeer meer veel weinig "
    "alle alles iets niets iemand niemand elke elk ander andere eigen zelf alleen samen verder eerst laatste "
    "twee drie vier vijf zes zeven acht negen tien "
    "pagina bladzijde datum naam adres www http https com org net"
).split()

PLACEHOLDERS = ["null", "none", "n/a", "na", "not found", "not_found", "niet gevonden", "niet opgenomen", "unknown", "onbekend", "-", "--"]
NO_EVIDENCE = r"niet opgenomen|not found|niet gevonden|n/a"

INVISIBLE = (
    ("\\x{200B}-\\x{200F}", "Zero-width karakters"),
    ("\\x{2028}-\\x{2029}", "Line/paragraph separators"),
    ("\\x{FEFF}", "Byte order mark in tekst"),
    ("\\x{00AD}", "Soft hyphen (onzichtbaar)"),
    ("\\x{034F}", "Combining grapheme joiner"),
    ("\\x{2060}-\\x{2064}", "Word joiners"),
    ("\\x{180E}", "Mongolian vowel separator"),
    ("\\x{3164}", "Hangul filler"),
)
SUSPICIOUS_CREATORS = ("fpdf", "tcpdf", "wkhtmltopdf", "phantomjs", "puppeteer")
LEGITIMATE_PRODUCERS = ("adobe", "microsoft", "google", "apple", "libreoffice", "openoffice", "inkscape", "ghostscript", "pdflib", "itext", "apache")
PROGRAM_PRODUCERS = ("fpdf", "tcpdf", "dompdf", "mpdf", "python", "java", "php", "ruby")
DOUBTFUL_PRODUCERS = ("ilovepdf", "ilove pdf", "pdf converter", "pdfconverter", "unknown", "unnamed")
MIME_BY_EXTENSION = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "txt": "text/plain"}
RISK_WEIGHTS = {"LOW": 10, "MEDIUM": 30, "HIGH": 60, "CRITICAL": 100}
EVIDENCE_SCORES = {"exact_label": 60, "table_context": 40, "nearby_label": 30, "semantic": 10, "ambiguous": 0}
ROLE_SCORES = {"primary": 10, "unknown": 0, "secondary": -20, "example": -20, "background": -20}
#: Names in a picture's software tags, in the order in which they are tried, with risk level and confidence.
EDITING_SOFTWARE = (
    ("photoshop", "HIGH", 0.90),
    ("lightroom", "HIGH", 0.85),
    ("illustrator", "HIGH", 0.85),
    ("affinity photo", "HIGH", 0.80),
    ("gimp", "HIGH", 0.85),
    ("inkscape", "MEDIUM", 0.70),
    ("paint.net", "MEDIUM", 0.70),
    ("pixelmator", "MEDIUM", 0.65),
    ("canva", "MEDIUM", 0.65),
    ("snapseed", "MEDIUM", 0.60),
    ("paint ", "MEDIUM", 0.65),
    ("acrobat", "MEDIUM", 0.55),
    ("irfanview", "LOW", 0.50),
    ("preview", "LOW", 0.40),
)
#: Other names of fields.
ALIASES = {"energylabel": "energielabel"}
#: Words in a field's names that call for further search terms, and these terms.
SYNONYMS = (
    (("m2", "oppervlakte", "area"), ("m2", "m 2", "oppervlakte", "vloeroppervlak", "gebruiksoppervlakte", "floor area", "area")),
    (("bouwjaar", "construction year", "built year"), ("bouw jaar", "bouwjaar", "construction year", "built", "built year")),
    (("energielabel", "energie label"), ("energielabel", "energie label", "energieklasse", "energieprestatie", "energie certificaat", "epc", "duurzaamheid", "energieprestatie-indicatoren", "nta 8800", "energieklasse woning")),
    (("exploitatielasten", "exploitatie lasten"), ("exploitatielasten", "totale exploitatielasten", "exploitatiekosten", "exploitatie kosten", "kapitalisatiefactoren", "bar nar kapitalisatie", "barinar kapitalisatie")),
    (("locatie_beoordeling", "locatie beoordeling"), ("ligging", "locatie", "beoordeling locatie", "locatiebeoordeling", "bereikbaarheid", "omgeving", "locatie beoordeling")),
    (("vastgoedtype", "type vastgoed", "vastgoed type"), ("vastgoedtype", "type vastgoed", "bedrijfsruimte", "gebruik", "bestemming", "object type", "soort vastgoed", "bedrijfsverzamelgebouw", "appartementsrecht")),
)
#: Sections without values, and words of explanations.
GENERIC_SECTIONS = ("inhoudsopgave", "table of contents", "disclaimer", "definities", "definitions", "bijlage index", "appendix index")
EXPLANATION = r"\b(is|betekent|wordt|hiermee|uitleg|explanation|means|defined|definition)\b"
