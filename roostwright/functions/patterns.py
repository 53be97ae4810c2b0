"""Patterns of the listing texts, written for Java's regex engine so that they match as ECMAScript ones would.

Word boundaries are ASCII ones, white space includes the Unicode spaces, and letters are folded with accents.
"""

# The spaces, number formats, words and phrases that listings are read by.
INLINE = r" \t\u00A0\u2000-\u200A\u202F\u205F\u3000\u200B\uFEFF"
THOUSANDS = r" \u00A0\u2000-\u200A\u202F\u205F\u3000\u200B\uFEFF.,"
_SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = rf"[{_SPACES}]"
W = "[A-Za-z0-9_]"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
I = "(?iu)"

ON_REQUEST = rf"{I}price{SPACE}+upon{SPACE}+request|prix{SPACE}+sur{SPACE}+demande"
ROOM_SHARE = rf"{I}{EDGE}(?:colocation|coloc|colocataires?|roommate|shared{SPACE}+room|coliving){EDGE}"
SOLD_EN = rf"{I}{EDGE}(?:sold|under preliminary sales agreement){EDGE}"
SOLD_FR = rf"{I}{EDGE}vendu{EDGE}"

_GAP = rf"[{INLINE}]*"
_NUMBER = rf"(?<!\d)((?:\d{{1,3}}(?:[{THOUSANDS}]\d{{3}})+|\d+))"
PRICES = (
    rf"{I}{_NUMBER}{_GAP}€{_GAP}/{_GAP}(?:mois|month)",
    rf"{I}€{_GAP}{_NUMBER}{_GAP}/{_GAP}(?:mois|month)",
    rf"{_NUMBER}{_GAP}€",
    rf"{I}€{_GAP}{_NUMBER}(?!{_GAP}(?:AED|\$|USD|CHF|£|₪|¥))",
)
BEDROOMS = rf"{I}(\d+){SPACE}*(?:bedrooms?|chambres?)(?![a-zA-Z])"
ROOMS = rf"{I}{EDGE}T(\d+){EDGE}|{EDGE}(\d+){SPACE}*(?:pi[eè]ces?|rooms?)(?![a-zA-Z])"
BATHROOMS = rf"{I}(\d+|une?){SPACE}*(?:bathrooms?|salles?{SPACE}+de{SPACE}+bains?|salles?{SPACE}+d'eau|wc|toilettes?)(?![a-zA-Z])"
_AREA = rf"{I}(?<!\d)(\d[\d{INLINE}]*(?:[.,]\d+)?)[{INLINE}]*(?:m²|m2|sqm)"
SURFACES = (rf"{_AREA}{EDGE}(?!{W})", _AREA)

_ARR = "(?:[1-9]|1[0-9]|20)"
_ORDINAL = "(?:er|ème|eme|e|th|st|nd|rd)"
PARIS = rf"{I}Paris{SPACE}*{_ARR}{SPACE}*{_ORDINAL}{EDGE}|Paris{SPACE}*{_ARR}(?!{SPACE}*\d){EDGE}"
STREET = rf"{I}(?<![a-zA-Z])(\d+[ \t]+(?:rue|avenue|boulevard|place|square|allée|chemin|quai)[^,\n|]*)"
POSTAL = rf"({EDGE}7\d{{4}}{EDGE}[^,\n|]*)"
BADGE_LINE = rf"{I}^(?:exclusivit[ée]|nouveau|appartement|maison|studio|duplex|loft|new|price on request|furnished apartment for rent|unfurnished apartment for rent)$"
PRICE_LINE = rf"{I}^\d[\d{_SPACES}.,]*{SPACE}*€{SPACE}*(?:/{SPACE}*(?:mois|month))?{SPACE}*(?:charges? (?:comprises?|incluses?)|hors charges)?{SPACE}*$"
REFERENCE_LINE = rf"{I}^ref\.?{SPACE}*\d+$"
PHOTO_LINE = rf"^\d+{SPACE}*/{SPACE}*\d+$"

NO_LIFT = rf"{I}{EDGE}sans{SPACE}+ascenseur{EDGE}|{EDGE}no{SPACE}+lift{EDGE}"
LIFT = rf"{I}{EDGE}(?:lift|elevator|ascenseur){EDGE}"
BALCONY = rf"{I}{EDGE}(?:balcony|balcon){EDGE}"
UNFURNISHED = rf"{I}{EDGE}unfurnished{EDGE}|{EDGE}non(?:{SPACE}|-)?meublé"
FURNISHED = rf"{I}{EDGE}furnished{EDGE}|{EDGE}meublé"
DETAIL_BATHROOMS = (rf"{I}(\d+|une?){SPACE}*salles?{SPACE}*(?:de)?{SPACE}*(?:bain|douche|d'eau)s?", rf"{I}(\d+|une?){SPACE}*(?:bathrooms?|wc|toilettes?|sdb){EDGE}")

ARRONDISSEMENTS = (
    rf"{I}paris{SPACE}*(\d{{1,2}}){SPACE}*{_ORDINAL}{EDGE}|paris{SPACE}*(\d{{1,2}})(?!{SPACE}*\d){EDGE}",
    rf"{I}(\d{{1,2}}){SPACE}*(?:ème|eme|th|st|nd|rd){SPACE}*(?:arrondissement|district)",
    rf"\(?{EDGE}750(\d{{2}}){EDGE}\)?",
)
STATED_ANYWHERE = rf"{I}(\d(?:\d|{SPACE})*){SPACE}*annonces"
STATED_HEADING = rf"{I}^{SPACE}*(\d(?:\d|{SPACE})*?){SPACE}*(?:annonces|appartements|maisons)"
