"""Tables, word lists and patterns that results depend on, stated as they are."""

from __future__ import annotations

# Document kinds as (kind, label, mime type, other mime types, extensions, extractable, exportable, quota, unit, container).
_OOXML = "application/vnd.openxmlformats-officedocument"
FORMATS = [
    ("pdf", "PDF", "application/pdf", "", "pdf", True, True, "pdfPages", "pages", "flat"),
    ("docx", "Word (.docx)", f"{_OOXML}.wordprocessingml.document", "", "docx", True, True, "docxPages", "pages", "ooxml"),
    ("xlsx", "Excel (.xlsx)", f"{_OOXML}.spreadsheetml.sheet", "", "xlsx", True, True, "xlsxCells", "filled cells", "ooxml"),
    ("csv", "CSV", "text/csv", "", "csv", True, True, "xlsxCells", "filled cells", "flat"),
    ("tsv", "TSV", "text/tab-separated-values", "", "tsv tab", True, True, "xlsxCells", "filled cells", "flat"),
    ("txt", "Plain text (.txt)", "text/plain", "", "txt text log", True, True, "textPages", "pages of extracted text", "flat"),
    ("rtf", "Rich text (.rtf)", "application/rtf", "text/rtf", "rtf", True, True, "textPages", "pages of extracted text", "flat"),
    ("eml", "Email (.eml)", "message/rfc822", "", "eml mime", True, True, "emailKilobytes", "kibibytes of decoded text", "mime"),
    ("pptx", "PowerPoint (.pptx)", f"{_OOXML}.presentationml.presentation", "", "pptx", True, True, "pptxSlides", "slides", "ooxml"),
    ("mbox", "Mailbox (.mbox)", "application/mbox", "", "mbox", False, False, "emailKilobytes", "kibibytes of decoded text, charged per message", "mime"),
    ("image", "Images (PNG, JPEG, WebP)", "image/png", "image/jpeg image/webp", "png jpg jpeg webp", True, True, "images", "images", "flat"),
]

# Categories with the methods each allows, and the stem of its surrogates.
METHODS = ("mask", "pseudonymize", "tokenize", "encrypt")
CATEGORIES = {
    "person": ("mask pseudonymize tokenize encrypt", "PERSON"),
    "address": ("mask encrypt", "ADDRESS"),
    "phone": ("mask pseudonymize tokenize encrypt", "PHONE"),
    "email": ("mask pseudonymize tokenize encrypt", "EMAIL"),
    "government-id": ("mask", "VALUE"),
    "bank-account": ("mask", "VALUE"),
    "financial": ("mask", "VALUE"),
    "date-of-birth": ("mask encrypt", "DOB"),
    "customer-id": ("mask pseudonymize tokenize encrypt", "CUSTOMER"),
    "confidential": ("mask", "VALUE"),
    "api-key": ("mask", "VALUE"),
    "url": ("mask pseudonymize tokenize encrypt", "URL"),
    "face": ("mask", "VALUE"),
    "health": ("mask", "VALUE"),
    "other": ("mask", "VALUE"),
}
#: From the strongest: what a value gets that several methods were asked for.
STRENGTH = ("mask", "pseudonymize", "encrypt", "tokenize")

# Presets as (id, detectors, categories); None is all.
PRESETS = [
    ("everything", None, None),
    ("names-and-contact-details", "email-address phone-number street-address", "person address phone email face"),
    ("identifiers-and-dates", "us-social-security labelled-national-id es-national-id fr-social-security de-tax-id labelled-reference labelled-date-of-birth", "government-id customer-id date-of-birth"),
    ("payment-and-account-numbers", "payment-card iban labelled-account-number", "financial bank-account"),
    ("credentials-and-keys", "credential link-with-token", "api-key url confidential"),
]

# Function words that only one of the four languages uses.
MARKERS = {
    "en": "the and of to is that with for are this from have not which were been would their they has",
    "de": "der das und ist nicht mit den dem ein eine einen auf für sich auch wird wurde bei nach oder sind zur zum vom wir ihre aus über wie",
    "fr": "le les et est une pour qui dans pas sur au aux avec ce cette sont nous vous été par leur mais où",
    "es": "el los las y del una por con para al lo su sus como más pero está fue este esta ha sobre también",
}
LANGUAGES = ("en", "de", "fr", "es")
LANGUAGE_NAMES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}

# Month names.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Jänner Februar März Maerz April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre",
}

# English labels before a value, matched at the end of the 40 characters before it.
ENGLISH_LABELS = {
    "birthDate": r"(d\.?o\.?b|date of birth|born|birth\s*date)[^\n]{0,12}\Z",
    "account": r"(account|acct|iban|sort\s*code)(?![A-Za-z0-9_])[^\n]{0,12}\Z",
    "reference": r"(customer|client|member|policy|reference|case|patient)\s*(id|no|number|#)?[^\n]{0,10}\Z",
    "documentNumber": r"(?<![A-Za-z0-9_])(?:(?:ref|reference|invoice|inv|transaction|txn|receipt|registration|vat|ein)(?![A-Za-z0-9_])|order\s*(?:no(?![A-Za-z0-9_])|number(?![A-Za-z0-9_])|#))[^\n0-9]{0,14}\Z",
}

# Labels of the other languages, matched at the end of the 64 characters before a value.
LABELS = {
    "de": {
        "birthDate": r"geburtsdatum|geburtstag|geb\.(?:-datum)?|geboren(?:\s+am)?",
        "account": r"konto\S*|bankverbindung|iban|blz",
        "reference": r"kunden(?:nummer|nr\.?|-nr\.?|-id)|aktenzeichen|az\.|fall(?:nummer|-nr\.?)|patienten(?:nummer|-nr\.?|-id)|versicherten(?:nummer|-nr\.?)|mitglieds(?:nummer|-nr\.?)|vorgangs?(?:nummer|-nr\.?)",
        "identity": r"(?:personal)?ausweis(?:nummer|-nr\.?)?|reisepass(?:nummer)?|pass(?:nummer|-nr\.?)|steuer-?id|identifikationsnummer|id-nr\.?|sozialversicherungsnummer|führerschein(?:nummer)?|gesundheitskarte|versicherten-?nr\.?",
        "documentNumber": r"rechnung\S*|referenz|buchung\S*|transaktion\S*|überweisung\S*|ust-?id\S*|handelsregister\S*",
    },
    "fr": {
        "birthDate": r"date de naissance|naissance|n[ée]\(?e?\)?\s+le|n[ée]e\s+le",
        "account": r"compte|iban|rib|coordonn[ée]es bancaires",
        "reference": r"client(?:e|es|s)?|patient(?:e|es|s)?|adh[ée]rent(?:e|es|s)?|dossier\s+(?:client|patient|salari[ée])e?|n[°o]\s*(?:de\s+)?police",
        "identity": r"carte nationale d['’]identit[ée]|cni|passeport(?:\s+n°)?|pi[èe]ce d['’]identit[ée]|num[ée]ro fiscal|s[ée]curit[ée] sociale|nir|permis de conduire|id national",
        "documentNumber": r"r[ée]f\.?|r[ée]f[ée]rence|facture|op[ée]ration|transaction|tva|siret|siren",
    },
    "es": {
        "birthDate": r"fecha de nacimiento|nacimiento|nacid[oa](?:\s+el)?|f\.\s?nac\.?",
        "account": r"cuenta|iban|ccc",
        "reference": r"client[ea]s?|paciente|caso|p[óo]liza|socio",
        "identity": r"dni|nie|nif|documento(?:\s+nacional)?\s+de\s+identidad|pasaporte|n[uú]mero de documento|permiso de conducir|tarjeta sanitaria|seguridad social",
        "documentNumber": r"factura|referencia|ref\.?|operaci[óo]n|transacci[óo]n|recibo|cif",
    },
}

# The detectors' patterns. B and E stand for an ASCII word boundary before and after.
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_UPPER, _LETTER = "A-ZÀ-ÖØ-Þ", "A-Za-zÀ-ÖØ-öø-ÿ"
_NAME = rf"[{_UPPER}][{_LETTER}'’-]*"
_CITY = rf"[{_UPPER}][{_LETTER}'’.-]*(?:[ -](?:am |an der |sur |de |del |la )?[{_UPPER}][{_LETTER}'’.-]*){{0,2}}"
_MONTH = "|".join(m for names in MONTHS.values() for m in names.split())
PATTERNS = {
    "email-address": r"(?i:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})",
    "phone-number": rf"(?<![{_LETTER}0-9])(?<![{_LETTER}0-9][-/])(?:(?:\+33[\s.]?|{B}0)[1-9](?:[\s.][0-9]{{2}}){{4}}{E}|{B}0[0-9]{{2,4}}/\s?[0-9]{{4,9}}{E}|\+[0-9]{{1,3}}\s?\(0\)\s?[0-9]{{2,4}}[\s-]?[0-9]{{3,8}}(?:[\s-][0-9]{{1,5}})?{E}|(?:\+[0-9]{{1,3}}[\s.-]?|1[\s.-])?(?:\([0-9]{{2,4}}\)[\s.-]?|[0-9]{{2,5}}[\s.-])[0-9]{{3,4}}[\s.-]?[0-9]{{3,4}}{E})",
    "us-social-security": rf"{B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{E}",
    "payment-card": rf"{B}(?:[0-9][ -]*?){{13,19}}{E}",
    "iban": rf"{B}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|\s[A-Z0-9]{{4}}(?:\s(?=[A-Z]{{0,3}}[0-9])[A-Z0-9]{{4}}){{1,6}}(?:\s[0-9]{{1,3}})?){E}",
    "labelled-account-number": rf"{B}[0-9]{{8,17}}{E}",
    "credential": rf"{B}(?:sk|pk|rk)[-_](?:live|test|prod)?[-_]?[A-Za-z0-9]{{16,}}|{B}gh[pousr]_[A-Za-z0-9]{{20,}}|{B}AKIA[0-9A-Z]{{16}}{E}|{B}AIza[0-9A-Za-z_-]{{35}}{E}",
    "labelled-date-of-birth": rf"{B}(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+[0-9]{{1,2}},?\s+[0-9]{{4}}|[0-9]{{1,2}}\.?\s+(?:de\s+)?(?:{_MONTH})\s+(?:de\s+)?[0-9]{{4}}){E}",
    "labelled-reference": rf"{B}[A-Z]{{1,5}}(?:-[A-Z]{{1,3}})?-?[0-9]{{3,10}}(?:-[0-9A-Z]{{1,6}})*{E}",
    "labelled-national-id": rf"{B}(?=[A-Z]*[0-9])[A-Z0-9]{{6,12}}{E}|{B}[0-9]{{1,3}}(?: [0-9]{{2,8}}){{2,6}}{E}",
    "es-national-id": rf"{B}(?:[0-9]{{8}}|[XYZ][0-9]{{7}})-?[A-Z]{E}",
    "fr-social-security": rf"{B}[12] ?[0-9]{{2}} ?[0-9]{{2}} ?(?:[0-9]{{2}}|2[AB]) ?[0-9]{{3}} ?[0-9]{{3}} ?[0-9]{{2}}{E}",
    "de-tax-id": rf"{B}[1-9][0-9] [0-9]{{3}} [0-9]{{3}} [0-9]{{3}}{E}",
    "link-with-token": rf"{B}(?i:https?)://[^\s<>\"')]+",
    "street-address": rf"{B}[0-9]{{1,5}}\s+[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){{0,3}}\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Terrace|Place|Pl){E}\.?",
}
STREETS = {
    "de": rf"(?:{B}(?:Am|An der|Im|In der|Auf dem|Zum|Zur) )?(?<![{_LETTER}])(?:[{_UPPER}][a-zäöüß]+ (?:Straße|Strasse|Str\.|Weg|Allee|Platz|Ring|Damm|Ufer|Gasse|Chaussee)|[{_UPPER}][a-zäöüß]+(?:-[{_UPPER}][a-zäöüß]+)*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|stieg|chaussee|pfad|graben|kamp|rain|bogen)) [0-9]{{1,4}}(?: ?[a-z]{E})?(?:,\s*[0-9]{{5}}\s{_CITY})?",
    "fr": rf"{B}[0-9]{{1,4}}(?: ?(?:bis|ter))?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Bb]d|[Pp]lace|[Cc]hemin|[Aa]llée|[Ii]mpasse|[Qq]uai|[Cc]ours|[Rr]oute|[Ss]quare|[Pp]assage) (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?{_NAME}(?: (?:(?:de la|des|du|de|d['’]|l['’]) ?)?{_NAME}){{0,3}}(?:,?\s[0-9]{{5}}\s{_CITY})?",
    "es": rf"{B}(?:[Cc]alle|C/|[Aa]venida|[Aa]vda\.|[Pp]aseo|[Pp]laza|[Pp]za\.|[Cc]amino|[Rr]onda|[Tt]ravesía|[Cc]arretera|[Gg]lorieta) (?:(?:de la|de los|de las|del|de) )?{_NAME}(?: (?:(?:de la|de los|de las|del|de) )?{_NAME}){{0,3}},? [0-9]{{1,4}}(?:,? ?(?:[0-9]{{1,2}}\.?\s?[ºª°](?: ?[A-Z]{E})?|bajo|entresuelo|ático))?(?:,\s[0-9]{{5}}\s{_CITY})?",
}
# Detectors as (id, category, confidence, everywhere, languages, label, reason).
DETECTORS = [
    ("email-address", "email", 0.97, True, None, None, "Matches an email address"),
    ("phone-number", "phone", 0.88, True, None, None, "Matches a telephone number"),
    ("us-social-security", "government-id", 0.95, True, None, None, "Matches a Social Security number"),
    ("payment-card", "financial", 0.94, True, None, None, "Passes the Luhn check for a payment card number"),
    ("iban", "bank-account", 0.93, True, None, None, "Matches an IBAN"),
    ("labelled-account-number", "bank-account", 0.70, True, None, "account", "A long number labelled as an account"),
    ("credential", "api-key", 0.96, True, None, None, "Matches a credential or API key format"),
    ("labelled-date-of-birth", "date-of-birth", 0.72, False, None, "birthDate", "A date labelled as a date of birth"),
    ("labelled-reference", "customer-id", 0.68, False, None, "reference", "An identifier labelled as a customer or case reference"),
    ("labelled-national-id", "government-id", 0.90, True, None, "identity", "A number labelled as an identity document or tax number"),
    ("es-national-id", "government-id", 0.92, True, "es", None, "A Spanish DNI or NIE with a valid check letter"),
    ("fr-social-security", "government-id", 0.92, True, "fr", None, "A French social security number (NIR) with a valid key"),
    ("de-tax-id", "government-id", 0.90, True, "de", None, "A German tax identification number with a valid check digit"),
    ("link-with-token", "url", 0.55, False, None, None, "A URL carrying what looks like a token or a private link"),
    ("street-address", "address", 0.60, False, None, None, "Matches a street address"),
]
#: A phone number after a document-number label.
DOUBTFUL_PHONE = 0.65

# Cost of a missed label by category (10, 5 or 2), and of a false positive.
FALSE_POSITIVE_COST = 1
MISS_COSTS = {
    "government-id": 10, "bank-account": 10, "financial": 10, "api-key": 10,
    "person": 5, "address": 5, "date-of-birth": 5, "email": 5, "phone": 5, "customer-id": 5,
    "confidential": 2, "url": 2, "other": 2,
}
CUTOFFS = (0.5, 0.7, 0.8, 0.9)
#: A value of fewer characters is not looked for in the output.
SEARCHED_LENGTH = 4
LABEL = "[REDACTED]"
