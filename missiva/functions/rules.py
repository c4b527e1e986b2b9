"""Word lists, labels and patterns whose exact form decides results."""

from __future__ import annotations

# French months by number.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")

# French month names without and with accents.
MONTH_NAMES = {
    "janvier": "janvier", "fevrier": "février", "février": "février", "mars": "mars", "avril": "avril", "mai": "mai",
    "juin": "juin", "juillet": "juillet", "aout": "août", "août": "août", "septembre": "septembre", "octobre": "octobre",
    "novembre": "novembre", "decembre": "décembre", "décembre": "décembre",
}

# Abbreviated months on stamps.
MONTH_STAMPS = {
    "JAN": "janvier", "FEV": "février", "FÉV": "février", "MAR": "mars", "AVR": "avril", "MAI": "mai", "JUI": "juin",
    "JUIN": "juin", "JUL": "juillet", "JUIL": "juillet", "AOU": "août", "AOÛ": "août", "SEP": "septembre",
    "SEPT": "septembre", "OCT": "octobre", "NOV": "novembre", "DEC": "décembre", "DÉC": "décembre",
}

# Month spellings by their first three letters, in the order that decides between them.
MONTH_STARTS = (
    ("JAN", "janvier"), ("FEV", "février"), ("MAR", "mars"), ("AVR", "avril"), ("MAI", "mai"), ("JUN", "juin"),
    ("JUI", "juin"), ("JUL", "juillet"), ("AOU", "août"), ("SEP", "septembre"), ("OCT", "octobre"), ("NOV", "novembre"),
    ("DEC", "décembre"),
)

# Spellings that the first three letters would take for another month.
MONTH_EXACT = {"JUIL": "juillet", "JUILLET": "juillet"}

# Arabic months, Moroccan and Levantine.
ARABIC_MONTHS = {
    "يناير": "janvier", "فبراير": "février", "مارس": "mars", "أبريل": "avril", "ابريل": "avril", "إبريل": "avril",
    "ماي": "mai", "مايو": "mai", "يونيو": "juin", "يونيه": "juin", "يوليوز": "juillet", "يوليو": "juillet",
    "يوليه": "juillet", "غشت": "août", "أغسطس": "août", "اغسطس": "août", "شتنبر": "septembre", "سبتمبر": "septembre",
    "أكتوبر": "octobre", "اكتوبر": "octobre", "نونبر": "novembre", "نوفمبر": "novembre", "دجنبر": "décembre",
    "ديسمبر": "décembre",
}

# Header ends, scan profile.
SCAN_HEADER_ENDS = (
    r"\n\s*[AÀ]\s*\n\s*(?:Monsieur|Madame|Mesdames|Messieurs|MONSIEUR)",
    r"Objet\s*:",
    r"[Oo]b[ji]et\s*:",
    r"[Vv]euillez\s+trouver\s+ci[\-\s]?joint",
    r"[Cc]oncern(?:e|ant)\s*:",
    r"\n\s*إلى\s*\n",
    r"إلى\s*\n+\s*(?:السيد|السيدة|السيدتين|السادة|السيدات|الأستاذ|رؤساء|عمداء|مديري)",
    r"الموضوع\s*[:.]",
    r"ال[مم]و[ضصظط]و[عغ]\s*[:.]",
    r"تجدون\s+طيه|تجدونه\s+رفقته",
    r"سلام\s+تام\s+بوجود",
    r"وبعد\s*[,،]?\s*\n",
)

# Header ends, text profile.
TEXT_HEADER_ENDS = (
    r"\n\s*[AÀ]\s*\n\s*(?:Monsieur|Madame|Mesdames|Messieurs|MONSIEUR)",
    r"\n\s*إلى\s*\n",
    r"إلى\s*\n+\s*(?:السيد|السيدة|السيدتين|السادة|السيدات|الأستاذ|رؤساء|عمداء|مديري)",
    r"Objet\s*:",
    r"الموضوع\s*[:.]",
    r"ال[مم]و[ضصظط]و[عغ]\s*[:.]",
    r"[Vv]euillez\s+trouver\s+ci[\-\s]?joint",
    r"تجدون\s+طيه",
    r"نوع\s+المراسل",
    r"سلام\s+تام\s+بوجود",
    r"وبعد\s*[,،]?\s*\n",
)

# Where the sender's zone ends.
RECIPIENT_START = (
    r"(?:^|\n)\s*(?:[AÀ]\s*[\n\s]+(?:Monsieur|Madame|Mesdames|Messieurs)|"
    r"إلى\s*[\n\s]+(?:السيد|السيدة|السيدتين|السادة|السيدات|الأستاذ|رؤساء|عمداء|مديري|أعضاء))"
)

# Arrival stamps, scan profile.
SCAN_STAMPS = (
    r"PR[EÉ]SIDENCE\s+DE\s+L['\x{2018}\x{2019}`´\s]*UN\w*[\s\S]{0,80}?CADI\s+AYY?A[DP][\s\S]{0,50}?MAR\w*",
    r"CADI\s+AYY?A[DP]\s*[\-',]?\s*MAR\w*",
    r"ر[ئي]اس[ةه]\s+جامع[ةه]\s+القاض[ىي]\s+عياض",
)
SCAN_STAMP_MARKS = (
    r"Arriv[eé]\s*(?:le)?",
    r"Sous\s+(?:N[°ºoO]|h)",
    r"ورد\s+يوم|رقم",
    r"\d{1,2}\s+(?:AVR|JAN|FEV|MAR|MAI|JUI|AOU|SEP|OCT|NOV|DEC)",
)
SCAN_STAMP_NUMBERS = (
    r"Arriv[eé]\s*(?:le)?\s*[:.]?\s*(\d{3,5})",
    r"Sous\s+(?:N[°ºoO]|h)\s*[:.]?\s*(\d{3,5})",
    r"رقم\s*[:.]?\s*(\d{3,5})",
)

# Institutions with priority, scan profile.
INSTITUTIONS = [
    (r"[Cc]entre\s+R[eé]gional\s+d[']?[Ii]nvestissement.{0,30}?Marrakech|CRI[\s\-\.]*RMS|CRI[\s\-]+Marrakech", "CRI Marrakech-Safi", 10),
    (r"Facult[eé]\s+des\s+Sciences\s+Semlalia|FSSM|FSS\s*Semlalia|Sciences\s+Semlalia", "FSS Semlalia", 10),
    (r"Facult[eé]\s+des\s+Sciences\s+Juridiques.{0,40}?[Mm]arrakech|FSJES|Sciences\s+Juridiques.{0,40}?[eE]conomiques", "FSJES Marrakech", 10),
    (r"Facult[eé]\s+des\s+Sciences\s+et\s+Techniques|FSTG?\b|Sciences\s+et\s+Techniques.{0,20}?Marrakech", "FST Marrakech", 10),
    (r"Facult[eé]\s+Polydisciplinaire.{0,20}?Safi|FP\s*Safi|FPS\b", "FP Safi", 10),
    (r"Facult[eé]\s+de\s+M[eé]decine\s+et\s+de\s+Pharmacie|FMPM\b|Médecine\s+et\s+Pharmacie", "FMP Marrakech", 10),
    (r"Facult[eé]\s+des\s+Lettres\s+et\s+des?\s+Sciences\s+Humaines|FLSH\b", "FLSH Marrakech", 10),
    (r"[EÉ]cole\s+Nationale\s+des\s+Sciences\s+Appliqu[eé]es|ENSA\b", "ENSA Marrakech", 10),
    (r"[EÉ]cole\s+Sup[eé]rieure\s+de\s+Technologie.{0,20}?Essaouira|EST.{0,5}?Essaouira|ESTE\b", "EST Essaouira", 10),
    (r"[EÉ]cole\s+Sup[eé]rieure\s+de\s+Technologie.{0,20}?Safi|EST.{0,5}?Safi", "EST Safi", 10),
    (r"Pr[eé]sidence.{0,30}?(?:Cadi\s+Ay?yad|Université)|La\s+Pr[eé]sidence|Royaume\s+du\s+Maroc.{0,30}?Pr[eé]sidence", "Présidence UCA", 8),
    (r"Universit[eé]\s+Cadi\s+Ay?yad|UCAM", "Université Cadi Ayyad", 5),
    (r"رئاسة\s+جامعة\s+القاض[يى]\s+عياض|^\s*الرئاسة\s*$|الرئاسة\b", "Présidence UCA", 10),
    (r"كلية\s+العلوم\s+القانونية\s+والاقتصادية\s+والاجتماعية", "FSJES Marrakech", 10),
    (r"كلية\s+العلوم\s+القانونية", "FSJES Marrakech", 9),
    (r"كلية\s+العلوم\s+والتقنيات", "FST Marrakech", 10),
    (r"كلية\s+العلوم\s+السملالية|كلية\s+العلوم\s+سملالية", "FSS Semlalia", 10),
    (r"كلية\s+الطب\s+والصيدلة", "FMP Marrakech", 10),
    (r"كلية\s+الآداب\s+والعلوم\s+الإنسانية", "FLSH Marrakech", 10),
    (r"الكلية\s+المتعددة\s+التخصصات\s+بآسفي|الكلية\s+المتعددة\s+التخصصات", "FP Safi", 10),
    (r"المدرسة\s+الوطنية\s+للعلوم\s+التطبيقية", "ENSA Marrakech", 10),
    (r"المدرسة\s+العليا\s+للتكنولوجيا.{0,15}?الصويرة", "EST Essaouira", 10),
    (r"المدرسة\s+العليا\s+للتكنولوجيا.{0,15}?[آا]سفي", "EST Safi", 10),
    (r"المركز\s+الجهوي\s+ل[لإا]*ستثمار", "CRI Marrakech-Safi", 10),
    (r"جامعة\s+القاض[يى]\s+عياض", "Université Cadi Ayyad", 5),
]

# Titles of senders, scan profile.
TITLES = [
    (r"Le\s+Doyen\s+par\s+[Ii]nt[eé]rim", "Le Doyen par Intérim"),
    (r"Pour\s+le\s+Pr[eé]sident\s*[\n\r]+\s*Le\s+Vice[\s\-]?Pr[eé]sident", "Pour le Président, Le Vice-Président"),
    (r"Le\s+Vice[\s\-]?Pr[eé]sident", "Le Vice-Président"),
    (r"Le\s+Pr[eé]sident\b", "Le Président"),
    (r"La\s+Pr[eé]sidente\b", "La Présidente"),
    (r"Le\s+Directeur\s+G[eé]n[eé]ral", "Le Directeur Général"),
    (r"Le\s+Directeur\b", "Le Directeur"),
    (r"La\s+Directrice\b", "La Directrice"),
    (r"Le\s+Doyen\b", "Le Doyen"),
    (r"La\s+Doyenne\b", "La Doyenne"),
    (r"Le\s+Secr[eé]taire\s+G[eé]n[eé]ral", "Le Secrétaire Général"),
    (r"العميد\s+بالنيابة", "Le Doyen par Intérim"),
    (r"رئيس\s+الجامعة", "Le Président"),
    (r"نائب\s+رئيس\s+الجامعة", "Le Vice-Président"),
    (r"العميد\b", "Le Doyen"),
    (r"العميدة\b", "La Doyenne"),
    (r"المدير\s+العام", "Le Directeur Général"),
    (r"المدير\b", "Le Directeur"),
    (r"المديرة\b", "La Directrice"),
    (r"الأمين\s+العام", "Le Secrétaire Général"),
]
ARABIC_TITLES = {
    "عميد": "Le Doyen", "عميدة": "La Doyenne", "مدير": "Le Directeur", "مديرة": "La Directrice",
    "رئيس": "Le Président", "نائب رئيس": "Le Vice-Président",
}

# Document types, scan profile, in the order that decides between them.
TYPES = [
    (r"[Bb]ordereau\s+d[']?envoi|BORDEREAU\s+D[']?ENVOI|BORDERAU|BORDEREAtJ|ورقة\s+الإرسال|بيان\s+الإرسال|كشف\s+الإرسال|إرسالية", "bordereau"),
    (r"[Nn]ote\s+(?:de\s+service|interne|d[']?information)|NOTE\s+DE\s+SERVICE|مذكرة\s+(?:إدارية|داخلية|خدمة)?", "note"),
    (r"[Cc]irculaire\b|CIRCULAIRE|منشور\b|دورية\b", "circulaire"),
    (r"\b[Ii]nvitation\b|\b[Cc]onvocation\b|دعوة\s+لحضور|استدعاء|يشرفنا\s+أن\s+ندعوكم|نتشرف\s+بدعوتكم", "invitation"),
    (r"[Pp]roc[eè]s[\s\-]verbal|\bPV\b|محضر\s+اجتماع|\bمحضر\b", "pv"),
    (r"\b[Cc]onvention\b|\b[Cc]ontrat\b|اتفاقية|\bعقد\b", "convention"),
    (r"[Aa]ttestation\b|شهادة\b", "attestation"),
    (r"\b[Dd]emande\s+(?:de\b|d['])|طلب\b|التماس\b", "demande"),
    (r"\b[Rr]apport\b|تقرير\b", "rapport"),
    (r"\b[Dd]écision\b|قرار\b", "decision"),
]

# Issuing bodies, scan profile.
BODIES_FR = [
    (r"[Cc]entre\s+R[eé]gional\s+d[']?[Ii]nvestissement[\s\S]{0,30}?Marrakech|CRI[\s\-\.]*R?M?S?", "CRI-Marrakech-Safi"),
    (r"Facult[eé]\s+des\s+Sciences\s+Semlalia|FSSM\b", "FSS-Marrakech"),
    (r"Facult[eé]\s+des\s+Sciences\s+Juridiques|FSJES\b", "FSJES-Marrakech"),
    (r"Facult[eé]\s+des\s+Sciences\s+et\s+Techniques|FSTG?\b", "FST-Marrakech"),
    (r"Facult[eé]\s+Polydisciplinaire.{0,20}?Safi|FP\s*Safi", "FP-Safi"),
    (r"Facult[eé]\s+de\s+M[eé]decine\s+et\s+de\s+Pharmacie|FMPM\b", "FMP-Marrakech"),
    (r"Facult[eé]\s+des\s+Lettres|FLSH\b", "FLSH-Marrakech"),
    (r"[EÉ]cole\s+Nationale\s+des\s+Sciences\s+Appliqu[eé]es|ENSA\b", "ENSA-Marrakech"),
    (r"[EÉ]cole\s+Sup[eé]rieure\s+de\s+Technologie.{0,15}?Essaouira", "EST-Essaouira"),
    (r"[EÉ]cole\s+Sup[eé]rieure\s+de\s+Technologie.{0,15}?Safi", "EST-Safi"),
]
BODIES_AR = [
    (r"رئاسة\s+جامعة\s+القاض[يى]\s+عياض", "La Présidence - Marrakech"),
    (r"كلية\s+العلوم\s+القانونية", "FSJES-Marrakech"),
    (r"كلية\s+العلوم\s+والتقنيات", "FST-Marrakech"),
    (r"كلية\s+العلوم[\s\S]{0,20}?سملالية", "FSS-Marrakech"),
    (r"كلية\s+الطب\s+والصيدلة", "FMP-Marrakech"),
    (r"كلية\s+الآداب\s+والعلوم\s+الإنسانية", "FLSH-Marrakech"),
    (r"الكلية\s+المتعددة\s+التخصصات[\s\S]{0,30}?[آا]سفي", "FP-Safi"),
    (r"المدرسة\s+الوطنية\s+للعلوم\s+التطبيقية", "ENSA-Marrakech"),
    (r"المدرسة\s+العليا\s+للتكنولوجيا[\s\S]{0,15}?الصويرة", "EST-Essaouira"),
    (r"المدرسة\s+العليا\s+للتكنولوجيا[\s\S]{0,15}?[آا]سفي", "EST-Safi"),
    (r"المركز\s+الجهوي\s+ل[لإا]*ستثمار", "CRI-Marrakech-Safi"),
]
PRESIDENCY = "La Présidence - Marrakech"
PRESIDENT = "Le Président de l'Université Cadi Ayyad"
PRESIDENCY_LETTERHEAD = r"Universit[eé]\s+Cadi\s+Ayyad[^\n]*\n\s*La\s+Pr[eé]sidence"
PRESIDENCY_LINE = r"^\s*La\s+Pr[eé]sidence\s*$"

# Ends of a letter's body, scan profile.
BODY_ENDS = (
    r"\n\s*[Vv]euillez\s+agr[eé]er",
    r"\n\s*Nous\s+vous\s+prions",
    r"\n\s*Le\s+Pr[eé]sident\s*\n",
    r"\n\s*Le\s+Doyen\s*\n",
    r"\n\s*Le\s+Directeur\s*\n",
    r"\n\s*وتقبلوا",
    r"\n\s*وتفضلوا",
    r"\n\s*المرفقات",
    r"\n\s*Pi[eè]ces?\s+joint",
)

# Dates, scan profile: day, month, year; a numeric date counts in these years only.
SCAN_DATE_ARABIC = rf"(\d{{1,2}})\s+({'|'.join(ARABIC_MONTHS)})\s+(\d{{4}})"
SCAN_DATE_FRENCH = r"(\d{1,2})(?:er)?\s+([a-zA-ZéèêûôîÉÈÊÛÔÎ]+)\.?\s+(\d{4})"
SCAN_DATE_STAMP = r"(\d{1,2})\s+([A-ZÉÈ]{3,4})\.?\s+(\d{4})"
SCAN_DATE_NUMERIC = r"\b(\d{1,2})[\/\-\.](\d{1,2})[\/\-\.](\d{4})\b"
SCAN_NUMERIC_YEARS = (2020, 2030)

# letters' numbers, scan profile.
NUMBER_SLASH = r"N[°ºoO]\s*[:.]?\s*(\d{2,4})\s*/\s*(\d{3,5})"
NUMBER_BODY = r"N[°ºoO]\s*[:.]?\s*(\d{3,6})\s*/\s*(\d{2})\s*/\s*([A-Z\-]{2,10})"
NUMBER_ARABIC = r"رقم\s*[:.]?\s*[/\\]?\s*(\d{2,4})[\s/\\]{0,10}[=\-_]?\s*(\d{2,5})"
NUMBER_ARABIC_OTHER = r"العدد\s*[:.]?\s*(\d{3,6})\s*[/\\\-]\s*(\d{2,4})"
NUMBER_ALONE = r"(?:N[°ºoO'\"]\s*[:.]?\s*|رقم\s*[:.]?\s*)[\s\n]*(\d{3,5})\b(?!\s*/)"
NUMBER_ARABIC_ALONE = r"رقم\s*[:.]?\s*[/\\]?\s*(\d{3,5})"
NUMBER_FRAMED = r"[=_\[]\s*(\d{4,5})\s*[=_\]\-]"

# Subjects, scan profile, as (pattern, flags) in the order that decides between them; then what is enclosed.
SUBJECT_WORD = r"[_\*\[\]\s]*(?:OBJET|[O0Ø][bB][jJiI][eE][tTlL])[_\*\[\]\s]*"
SUBJECT_MARK = r"\s*[:;.,\-=]\s*"
SUBJECT_ARABIC = r"ال[مم]و[ضصظط]و[عغ]\s*[:.]?\s*"
SUBJECTS = (
    (rf"(?:^|\n|[\.\!\?]\s+){SUBJECT_WORD}{SUBJECT_MARK}(.+?)(?:\n\n|\n\s*(?:Monsieur|Madame|Mesdames|Messieurs|Cher|· |\* )|$)", "is"),
    (rf"(?:^|\n){SUBJECT_WORD}{SUBJECT_MARK}(.+?)(?:\n|$)", "im"),
    (rf"(?:CADI\s+AYYAD|UNIVERSIT[EÉ]|Cher|Madame|Monsieur)\s+{SUBJECT_WORD}{SUBJECT_MARK}(.+?)(?:\n|$)", "i"),
    (r"(?:^|\n)\s*[_\*]*\s*[Cc]oncern(?:e|ant)[_\*]*\s*[:;.\-]\s*(.+?)(?:\n|$)", "m"),
    (rf"{SUBJECT_ARABIC}(.+?)(?:\n\n|\n\s*(?:سلام|وبعد|في\s+إطار|بناء\s+على|نتشرف|يشرفنا|تحية))", "s"),
    (rf"{SUBJECT_ARABIC}(.+?)(?:\n|$)", ""),
)
SUBJECT_JOINT = r"[Vv]euillez\s+trouver\s+ci[\-\s]?joint\s*[,:.]?\s*\n+\s*(.+?)(?:\n\n|$)"
SUBJECT_ENCLOSED = r"تجدون(?:ه)?\s+(?:طيه|رفقته)\s*[:.]?\s*\n+\s*(.+?)(?:\n\n|$)"

# Recipients and senders, scan profile.
RECIPIENT_FRENCH = r"(?:^|\n)\s*[AÀ]\s*\n\s*((?:Monsieur|Madame|Mesdames|Messieurs|MONSIEUR|MADAME)\s+(?:le|la|les|LE|LA|LES)?\s*\w+[^\n]{0,200})"
RECIPIENT_ARABIC = (
    r"إلى\s*[\n\s]+((?:السيد|السيدة|السيدتين|السادة|السيدات|الأستاذ|الأستاذة|الدكتور|رؤساء|عمداء|مديري|أعضاء)[^\n]{5,250}(?:\n[^\n]{3,150})?)"
)
RECIPIENT_FREE = r"إلى\s*\n+\s*([^\n]{15,300})(?:\n([^\n]{5,200}))?"
RECIPIENT_NAMES = "السيد|السيدة|السيدتين|السادة|السيدات|رئيس|رؤساء|عميد|عمداء|مدير|مديري|المؤسسات|الكليات|الجامعة"
RECIPIENT_OVER = r"\A\s*(?:الموضوع|ال[مم]و[ضصظط]و[عغ]|سلام|وبعد|في\s+إطار)"
RECIPIENT_LABEL = r"[Dd]estinataire\s*[:.]\s*(.+?)(?:\n|$)"
RECIPIENT_ENDS = r"\s+(?:Objet|OBJET|Bordereau|BORDEREAU|الموضوع|ال[مم]و[ضصظط]و[عغ]|Nature|Nombre|Veuillez)\s*[:\s]"
SENDER_TITLED = r"من\s+(?:السيد|السيدة)?\s*(عميد|عميدة|مدير|مديرة|رئيس|نائب\s+رئيس)\s+([^\n]{5,100})"
SENDER_PRESIDENT = r"من\s+السيد\s+رئيس\s+الجامعة"

# Where a letter's body begins, scan profile.
BODY_OPENING = r"(?:Objet|الموضوع|ال[مم]و[ضصظط]و[عغ])\s*[:.]\s*[^\n]+\n+"
