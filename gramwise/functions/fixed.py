"""What the results depend on and no rule gives. Patterns are Java regular expressions."""

CURRENCY_SIGN = r"(?:CA\$|C\$|US\$|A\$|[$€£₹৳])"
PRICE = r"(?iu)(?:\b(?:CA\$|C\$|US\$|A\$)|[$€£₹৳])\s*\d{1,5}(?:[.,]\d{1,2})?|\b\d{1,5}(?:[.,]\d{1,2})?\s*(?:CAD|USD|EUR|GBP|INR|BDT)\b"
CURRENCY_CODE = r"(?i)[0-9]\s*(?:CAD|USD|EUR|GBP|INR|BDT)"
PRICE_NUMBER = r"\d{1,5}(?:[.,]\d{1,2})?"
CALORIES = r"(?iu)\b(\d{2,5}(?:[.,]\d+)?)\s*(?:k?cal(?:ories?)?)\b"
THOUSANDS = r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?$"

# Currency codes, in the order of their tests: code and sign-based spellings, which are case-sensitive.
CURRENCIES = (("CAD", ("C$", "CA$")), ("USD", ("US$",)), ("EUR", ("€",)), ("GBP", ("£",)), ("INR", ("₹",)), ("BDT", ("৳",)))
OTHER_CURRENCY = "USD/CAD"
SYMBOLS = {"EUR": "€", "GBP": "£", "INR": "₹", "BDT": "৳"}

# Choice of the price.
BUNDLE_PRICE = r"(?iu)\b(\d{1,2})\s*(?:for|/)\s*(" + CURRENCY_SIGN + r"\s*\d+(?:[.,]\d{1,2})?)"
CURRENT_PRICE = r"(?iu)\b(?:now|sale(?:\s+price)?|member(?:\s+price)?|deal(?:\s+price)?)\s*[:-]?\s*(" + CURRENCY_SIGN + r"\s*\d+(?:[.,]\d{1,2})?)"
SAVING_BEFORE = r"(?iu)\b(?:save|saving|discount|off)\s*$"
SALE_HINT = r"(?iu)\b(sale|now|deal|member|promo|offer|discount|save|regular|reg\.?|was)\b"

# Promotions, in the order of their tests.
BOGO_PERCENT = r"(?iu)\b(?:bogo|buy\s*one\s*(?:,|&|and)?\s*get\s*(?:one|1))\s*(\d{1,2})\s*%\s*off\b"
BOGO = r"(?iu)\b(?:bogo(?!\s*\d+\s*%\s*off)|buy\s*one\s*(?:,|&|and)?\s*get\s*(?:one|1)(?:\s*free)?(?!\s*\d+\s*%\s*off)|2\s*for\s*1|two\s*for\s*one)\b"
BUY_GET = r"(?iu)\bbuy\s+(\d+)\s+(?:and\s+)?get\s+(\d+)\s+(?:free|at\s+no\s+cost)\b"
BUNDLE = r"(?iu)\b(\d{1,2})\s*(?:for|/)\s*(?:ca\$|c\$|us\$|a\$|[$€£₹৳])\s*(\d+(?:[.,]\d{1,2})?)"
PERCENT_OFF = r"(?iu)\b(\d{1,2})\s*%\s*off\b"

# Quantities: grams and millilitres in a unit.
MASS = {"mg": 0.001, "g": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0, "oz": 28.349523125, "ounce": 28.349523125, "ounces": 28.349523125, "lb": 453.59237, "lbs": 453.59237, "pound": 453.59237, "pounds": 453.59237}
VOLUME = {"ml": 1.0, "milliliter": 1.0, "milliliters": 1.0, "l": 1000.0, "liter": 1000.0, "liters": 1000.0, "litre": 1000.0, "litres": 1000.0, "fl oz": 29.5735295625}
MULTIPACK = r"(?iu)\b(\d{1,3})\s*[x×]\s*(\d+(?:[.,]\d+)?)\s*(mg|g|grams?|kg|kilograms?|oz|ounces?|lb|lbs|pounds?|ml|l|litres?|liters?|fl\s*oz)\b"
RANGE = r"(?iu)\b(\d+(?:[.,]\d+)?)\s*[-–]\s*(\d+(?:[.,]\d+)?)\s*(g|kg|oz|lb|lbs|ml|l)\b"
SINGLE = r"(?iu)\b(\d+(?:[.,]\d+)?)\s*(mg|g|grams?|kg|kilograms?|oz|ounces?|lb|lbs|pounds?|ml|milliliters?|l|litres?|liters?|fl\s*oz)\b"
TIMES_BEFORE = r"\d+\s*[x×]\s*$"
COUNTS = (r"(?iu)\b(\d{1,4})\s*(?:count|ct|pieces?|pcs|pack|pk|units?|ea)\b", r"(?iu)\b(?:pack|box|case|set)\s+of\s+(\d{1,4})\b")
PIZZA = r"(?iu)\b(pizza|pie|flatbread)\b"
INCHES = r"(?iu)\b(\d{1,2}(?:[.,]\d+)?)\s*(?:in(?:ch(?:es)?)?|\")\b"
CENTIMETRES = r"(?iu)\b(\d{2,3}(?:[.,]\d+)?)\s*cm\b"

# Portions: servings named, then sizes, in the order of their tests.
FOOD_UNITS = r"(?iu)\b(\d{1,3})\s*(?:piece|pieces|pc|pcs|wings?|nuggets?|tenders?|patties|tacos?|burgers?|sandwiches?|slices?)\b"
SERVINGS = ((("triple",), 3.0, 0.66), (("double",), 2.0, 0.64), (("single",), 1.0, 0.60))
SIZES = (
    (("party", "feast"), 2.2, "party"),
    (("family", "sharing"), 1.8, "family"),
    (("extra large", "extra-large", "extralarge", "x large", "x-large", "xlarge", "xl"), 1.55, "extra large"),
    (("large",), 1.3, "large"),
    (("medium",), 1.0, "medium"),
    (("small",), 0.8, "small"),
    (("kid", "kids", "junior"), 0.65, "kids/junior"),
)
MEAL = ("combo", "meal")
# All of them, longer spellings before what they end with.
PORTION_WORDS = r"\b(?:" + "|".join(w for words, *_ in (*SERVINGS, *SIZES, (MEAL,)) for w in words) + r")\b"

# Names.
NOT_A_NAME = r"(?iu)^(?:add|customize|popular|sponsored|deal|sale|save|free delivery|buy one|get one|from\s+[$€£₹৳]|[$€£₹৳]\s*\d)"
NAME_AMOUNT = r"(?iu)\b\d+(?:[.,]\d+)?\s*(?:mg|g|grams?|kg|kilograms?|oz|ounces?|lb|lbs|pounds?|ml|milliliters?|l|litres?|liters?|fl\s*oz|cal|kcal|calories?|ct|count|pieces?|pcs|pack|pk|units?|ea)\b"
NAME_NOISE = r"(?iu)\b(?:bogo|sale|deal|add to cart|customize)\b"
UNNAMED = "Unnamed item"
NAME_LEAST, NAME_MOST = 2, 120

# How sure an item is: without anything, for its quantity's confidence, calories and a promotion, and at most.
SURE, SURE_QUANTITY, SURE_CALORIES, SURE_PROMOTION, SURE_MOST = 0.67, 0.18, 0.08, 0.03, 0.99
# Confidence of quantities: multipack, range, single, count, pizza; of food units, sizes and meals; and of no more than those.
PACK_SURE, RANGE_SURE, SINGLE_SURE, COUNT_SURE, PIZZA_SURE = 1.0, 0.7, 0.98, 0.9, 0.9
FOOD_SURE, SIZE_SURE, MEAL_SURE, PORTION_SURE = 0.72, 0.55, 0.50, 0.45
MEAL_FACTOR = 1.35
# How far before an amount a word makes it a saving, or a count makes it part of a pack.
SAVING_REACH, TIMES_REACH = 14, 8
PIZZA_INCHES = (5.0, 30.0)

# Labels.
BOGO_LABEL, BUY_LABEL, GET_LABEL, FOR_LABEL, OFF_LABEL = "Buy 1, get 1", "Buy ", ", get ", " for ", "% off"
FOOD_LABEL, MEAL_LABEL = " food units", "meal"
PRICE_ONLY = "price only"
NOTHING_YET = "No product cards found yet. Open a store/menu and tap Scan all."

# Collected items and what is shown of them.
KEPT, SHOWN, BADGE_MOST = 500, 60, 999

# Screens.
TOTALS = r"\b(subtotal|order total|estimated total|tax|service fee|delivery fee|tip|checkout)\b"
CARD_CLASS = "card|item|row|cell|viewgroup|layout"
SCROLL_CLASS = "recycler|list|scroll|webview|viewpager"
VISITED, SCROLL_VISITED, SUBTREE_NODES, SUBTREE_UNITS, CLIMB, OWN_MOST = 5000, 4000, 100, 1200, 7, 500
CANDIDATE_LENGTH = (4, 1400)
# A candidate's score: length within, length up to, length beyond; one price, up to three, others; class; bounds beyond.
SCORE_LENGTH = ((12, 700, 4.0), (1200, 1.0), -5.0)
SCORE_PRICES = ((1, 3.0), (3, 1.0), -4.0)
SCORE_CLASS, SCORE_BOUNDS, CARD_BOUNDS = 2.0, 1.0, (100, 35)
TALL, TALL_FACTOR, SCROLL_FACTOR = 0.55, 1.4, 1.35
# Rows before and after a line with a price.
AROUND = 2
# Scanning all ends after so many steps, or so many without a change.
STEPS, STALE = 90, 5
