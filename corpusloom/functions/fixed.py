"""Word lists, tables, patterns and texts that results depend on, as plain text.

Patterns begin with their flags; they are read by Java, so named groups are ``(?<name>...)``.
"""

# Fixed values follow: change them and results change.

# Lexical search: tokens, stop words, suffixes in the order they are tried.
TOKEN = r"[a-z][a-z0-9\-]{1,}"
STOPWORDS = (
    "the", "and", "for", "are", "with", "this", "that", "from", "have", "has", "can", "will", "you", "your", "not", "but", "all", "may", "should",
    "when", "which", "they", "them", "their", "there", "these", "those", "been", "was", "were", "into", "also", "such", "than", "then", "other",
    "more", "most", "some", "any", "how", "what", "why", "who", "where", "does", "did", "was",
)
SUFFIXES = (
    "ations", "ization", "iveness", "fulness", "ousness", "ation", "ingly", "edly", "ings", "ness", "ment", "ible", "able", "ives", "ing", "ish",
    "ies", "ied", "est", "ers", "ed", "es", "er", "ly", "s",
)

# Licences that exclude a document.
NO_DERIVATIVES = r"(?i)\bnd\b|\bnd-\d|noderiv|no.?deriv"
PROPRIETARY = "(?i)copyrighted|all rights reserved"

# Text quality and furniture.
FRONT_MATTER = (
    r"(?i)\b(?:isbn|issn|all rights reserved|library of congress|cataloguing|cataloging|first published|printed in|"
    r"reproduction of this|no part of this publication|correct citation|recommended citation|doi:|p\.?o\.? box|"
    r"tel(?:ephone)?:|fax:|e-?mail:|www\.)\b"
)
COPYRIGHT = r"(?i)©|\(c\)\s*\d{4}|copyright\s+\d{4}"
CAPTION = r"(?i)\b(?:Fig(?:ure)?|Table|Plate|Photo)s?\s*\.?\s*\d+(?:\.\d+)?\s*[:.\-]?\s*(?:(?!\s\d{1,4}\s)[^.\n]){0,80}"
PAGE_NUMBER = r"(?:(?<=\.)|(?<=\n)|^)\s*\d{1,4}\s*(?=[A-Z\n]|$)"
WEB_FURNITURE = (
    r"(?i)https?://\S+|www\.\S+|\bclick here\b|\bread more\b|\bdownload (?:the|this)\b[^.\n]{0,40}|\b(?:see|follow|refer to|"
    r"use) the link (?:provided|below|above)?|\bfor more information,?\s+(?:see|visit|go to|refer to)\s+the link\b|\b(?:see|"
    r"visit) (?:the )?(?:website|web ?page|link)\b"
)
BLANK_RUN = r"_{3,}|\.{4,}"
FORM_NUMBERING = r"(?im)^\s*(?:Q\s*\d+|\d+\.\d+\s*:|\(\s*[a-z]\s*\))"
SENTENCE_SPLIT = r"[.!?]+\s+"
SELF_ASSESSMENT = r"(?i)\b(?:have|do|did|are|is|can|will|would|should)\s+you(?:r)?\b"

# Chunks and sentences.
PARAGRAPH_SPLIT = r"\n\s*\n|\n(?=\s*(?:[-•*·]|\d+[.)]\s))|\n(?:\s*\d{1,4}\s*\n)?(?=[A-Z][^\n]{2,70}\n)"
SENTENCE_END = r"(?<=[.!?])\s+"
HEADING = "^(?:[A-Z][^.!?]{2,70}:?)$"
FIELD_LABEL = (
    r"(?i)^(?:damage\s+symptoms?|crop\s+damage(?:\s+symptoms?)?|symptoms?|signs?|appearance|description|identification|"
    r"introduction|remarks?|other\s+crops?(?:\s+attacked)?|host\s+plants?|biology|life\s+cycle|distribution|"
    r"economic\s+importance|damage|control|management|prevention|what\s+to\s+do|treatment|recommendations?)\b\s*:?\s*$"
)
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z(])"
SAFETY_CRITICAL = (
    r"(?i)\b(?:do not|don't|never|avoid|caution|warning|danger|toxic|poison|harmful|protective|withdrawal|residue|not "
    "recommended|banned|restricted|wear gloves|wash|keep away|children|livestock graze|water source|before harvest|days? "
    r"after)\b"
)

# HTML pages.
SKIPPED_TAGS = (
    "script", "style", "noscript", "svg", "canvas", "template", "nav", "header", "footer", "form", "select", "option", "button", "iframe", "aside",
)
CHROME_MARKERS = (
    "toolbar", "navbar", "region-nav", "region-header", "region-footer", "region-search", "search-block", "breadcrumb", "pager", "gtranslate",
    "sidebar", "social-share", "cookie", "skip-link", "block-system-branding",
)
BLOCK_TAGS = (
    "p", "div", "br", "li", "tr", "section", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dt", "dd",
)
BOILERPLATE_LINES = (
    "bookmark this page", "is this a minor pest?", "minor pest title", "minor pest description", "minor pest what to do.", "minor pest firstcontent",
    "minor pest position", "minor pest media gallery", "ph pests media gallery", "information source links", "information source link",
    "print this page", "share this page",
)
TAIL_MARKERS = (
    "information source link", "further reading", "references:",
)
BBCODE = r"(?i)\[/?(?:i|b|u|url[^\]]*|img[^\]]*)\]"
LITERAL_ESCAPE = r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[trn]"
LITERAL_TAG = r"(?i)</?\s*(?:b|i|u|em|strong|br|p|span|div|font)\b[^>]*>"
CREDIT_LINE = r"(?i)^[A-Z][A-Za-z.\- ]{2,40},\s*(?:icipe|Biovision|CABI|IITA|Bugwood\.org|Wikipedia|courtesy.*)$"

# Question preparation.
REPORTED_SPEECH = r"(?is)^.{0,160}?\b(?:says?|asks?|writes?|reports?|complains?|tells? (?:me|us))\b\s*[:,-]\s*"
INSTRUCTION = (
    r"(?i)^\s*(?:and\s+|also\s+|but\s+|then\s+)?(?:please\s+)?(?:explain|describe|list|outline|summari[sz]e|suggest|recommend|"
    r"advise|give|provide|tell\s+me|answer|respond|reply|write|prefer|favou?r|focus\s+on|keep\s+it|limit|restrict|do\s+not|"
    r"don't|avoid|never|without\s+(?:stating|giving|mentioning))\b"
)
CLAUSE = r"(?<=[.!?])\s+|,\s+(?=and\s+(?:do|give|prefer|explain|list)\b)"
SYMPTOM_WORDS = (
    "yellow", "yellowing", "yellowed", "brown", "black", "white", "spots", "spotted", "spotting", "streaks", "twisted", "twisting", "curling",
    "curled", "distorted", "deformed", "shrivelled", "shriveled", "wilting", "wilt", "wilted", "drooping", "rotting", "rot", "rotten", "mould",
    "mouldy", "mold", "mildew", "dying", "die", "died", "dead", "stunted", "small", "tiny", "holes", "eaten", "chewed", "bitten", "patches",
    "lesions", "blight", "scorched", "webbing", "sticky", "discoloured", "discolored", "swollen", "swelling", "limping", "coughing", "shaking",
    "trembling", "diarrhoea", "diarrhea", "weak", "thin", "lame", "sores", "scabs", "itching", "bleeding",
)
DIAGNOSTIC_INTENT = "disease symptoms cause control management"
SIGN_TO_NAME = (
    (r"(?:leaf|leaves)[^.]{0,40}(?:yellow\w*|mottl\w*|pale patch\w*)[^.]{0,30}(?:twist\w*|distort\w*|crinkl\w*|misshap\w*)|(?:yellow\w*|mottl\w*)[^.]{0,25}and[^.]{0,25}(?:twist\w*|distort\w*|crinkl\w*)", "cassava mosaic"),
    ("cottony|cotton-?like|white waxy|waxy coating|white powdery mass", "mealybug"),
    ("winding lines|wiggly lines|squiggly|tunnels? (?:in|inside) the leaves|trails? (?:in|inside) the leaves|mines? in the lea", "leafminer"),
    ("fine web|webbing|cobweb", "spider mite"),
    ("sooty|black mou?ld on the leaves", "sooty mould honeydew"),
    ("sawdust|frass|boring into|holes? in the stem", "borer"),
    (r"(?:seedlings?|young plants?|transplants?)[^.]{0,40}\b(?:cut|severed|chopped|felled)\b[^.]{0,30}(?:base|ground|soil|stem)|\b(?:cut|cuts|cutting down|severed)\b[^.]{0,30}(?:seedlings?|young plants?)[^.]{0,30}(?:base|ground|night|soil)", "cutworm"),
    ("twisted neck|neck (?:is )?twist|head (?:pulled|twisted) back", "newcastle disease"),
    ("greenish watery|green watery droppings?", "newcastle disease"),
    ("pot ?belly|swollen (?:under the )?jaw|bottle jaw", "worms helminth"),
    (r"left side[^.]{0,20}swollen|swollen[^.]{0,15}left side|\bbloat(?:ed|ing)?\b|distended[^.]{0,15}(?:side|belly|stomach)|tight[^.]{0,20}(?:after|from) graz", "bloat"),
    (r"\blimp(?:ing|s)?\b|not put(?:ting)? weight|\blame\b|favour(?:ing)? one leg|holding up (?:a|one) (?:leg|foot)", "foot rot"),
)

# Relevance lexicons.
POSITIVE_GROUPS = {
    "symptom": (
        "wilting", "wilt", "yellowing", "chlorosis", "curling", "mottling", "mosaic", "streak", "lesion", "lesions", "spots", "blight", "rot",
        "rotting", "stunted", "stunting", "necrosis", "necrotic", "galls", "dieback", "canker", "mildew", "rust", "scorch", "defoliation",
        "discoloured", "discolored", "malformed", "shrivelled",
    ),
    "organism": (
        "larva", "larvae", "caterpillar", "caterpillars", "aphid", "aphids", "mite", "mites", "whitefly", "whiteflies", "mealybug", "mealybugs",
        "weevil", "weevils", "borer", "borers", "nematode", "nematodes", "thrips", "beetle", "beetles", "grub", "grubs", "armyworm", "moth",
        "fungus", "fungal", "bacterial", "bacterium", "virus", "viral", "pathogen", "infestation", "infested", "vector", "grasshopper", "termite",
        "termites", "scale insect",
    ),
    "control": (
        "spray", "spraying", "roguing", "rogue", "uproot", "prune", "pruning", "rotation", "intercrop", "intercropping", "resistant variety",
        "resistant varieties", "tolerant variety", "clean planting material", "certified seed", "weeding", "mulch", "mulching", "trap", "trapping",
        "biological control", "natural enemies", "biopesticide", "neem", "sanitation", "solarisation", "fallow", "destroy infected",
        "remove infected", "burn residues", "handpick", "handpicking", "threshold", "scouting", "monitor the crop",
    ),
    "agronomy": (
        "spacing", "planting", "sowing", "transplanting", "harvest", "harvesting", "storage", "cuttings", "stem cuttings", "seed rate", "ridges",
        "mounds", "manure", "compost", "fertiliser", "fertilizer", "topdressing", "irrigation", "drainage", "soil fertility", "yield", "germination",
        "nursery", "seedbed", "field", "farmers should",
    ),
    "livestock": (
        "cattle", "cow", "cows", "calf", "calves", "goat", "goats", "sheep", "lamb", "poultry", "chicken", "chickens", "hen", "hens", "cockerel",
        "broiler", "layer", "pig", "pigs", "swine", "livestock", "herd", "flock", "grazing", "browse", "fodder", "forage", "silage", "deworming",
        "dewormer", "vaccination", "vaccinate", "newcastle", "foot and mouth", "mastitis", "brucellosis", "trypanosomiasis", "tick", "ticks",
        "tsetse", "anthelmintic", "withdrawal period", "calving", "kidding", "farrowing", "weaning", "stocking rate", "veterinary", "animal health",
        "lameness", "diarrhoea", "diarrhea",
    ),
    "weather": (
        "rainfall", "rains", "rainy season", "dry season", "harmattan", "onset of rains", "cessation", "planting calendar", "planting date",
        "growing season", "drought", "dry spell", "flooding", "waterlogging", "humidity", "temperature", "agro-ecological zone", "agroecological",
        "climate", "seasonal forecast", "early planting", "late planting", "soil moisture", "evapotranspiration", "mulch to conserve moisture",
    ),
    "market": (
        "market", "markets", "price", "prices", "marketing", "buyer", "buyers", "trader", "traders", "middleman", "aggregation", "bulking",
        "grading", "quality standard", "value addition", "processing", "gari", "flour", "storage loss", "post-harvest loss", "postharvest",
        "shelf life", "packaging", "transport cost", "cooperative", "farmer group", "contract", "off-taker", "gross margin", "profit",
        "cost of production", "sell",
    ),
}
INSTITUTIONAL_TERMS = (
    "stakeholder", "stakeholders", "deliverable", "deliverables", "work package", "workplan", "milestone", "milestones", "donor", "donors",
    "consortium", "theory of change", "logframe", "log frame", "monitoring and evaluation", "inception report", "steering committee", "disbursement",
    "budget allocation", "co-funding", "grant agreement", "annual report", "progress report", "workshop participants", "focus group discussion",
    "key informant", "questionnaire", "respondents", "sampling frame", "regression", "econometric", "randomised controlled", "randomized controlled",
    "p-value", "significant at", "gender mainstreaming", "empowerment index", "terms of reference", "project team", "implementing partner",
    "scaling readiness", "impact pathway", "reporting period",
)
CROP_TERMS = {
    "cassava": (
        "cassava", "manihot",
    ),
    "maize": (
        "maize", "zea mays",
    ),
    "yam": (
        "yam", "yams", "dioscorea",
    ),
    "tomato": (
        "tomato", "tomatoes", "lycopersicon",
    ),
    "rice": (
        "rice", "oryza",
    ),
    "cowpea": (
        "cowpea", "cowpeas", "vigna unguiculata",
    ),
    "groundnut": (
        "groundnut", "groundnuts", "arachis",
    ),
    "pepper": (
        "pepper", "peppers", "capsicum",
    ),
    "okra": (
        "okra", "abelmoschus",
    ),
}
OTHER_CROP_TERMS = (
    "bean", "beans", "phaseolus", "papaya", "pawpaw", "carica", "mango", "citrus", "avocado", "pineapple", "watermelon", "cocoa", "cacao", "coffee",
    "cashew", "oil palm", "banana", "plantain", "sugarcane", "cotton", "sorghum", "millet", "wheat", "sesame", "soybean", "soya", "soyabean",
    "sweet potato", "sweetpotato", "cocoyam", "taro", "onion", "cabbage", "carrot", "lettuce", "cucumber",
)
AFRICA_TERMS = (
    "africa", "african", "nigeria", "nigerian", "west africa", "sub-saharan", "subsaharan", "ghana", "benin", "togo", "cameroon", "côte d'ivoire",
    "cote d'ivoire", "ivory coast", "kenya", "tanzania", "uganda", "ethiopia", "malawi", "zambia", "mozambique", "burkina", "mali", "senegal",
    "sahel", "savanna", "savannah", "ibadan", "lagos", "oyo state", "iita", "icipe", "cgiar",
)
ELSEWHERE_TERMS = (
    "micronesia", "pacific island", "caribbean", "latin america", "south america", "central america", "philippines", "indonesia", "vietnam",
    "thailand", "bangladesh", "sri lanka", "nepal", "australia", "new zealand", "european union", "united kingdom", "united states",
    "u.s. department", "usda", "canada", "california", "florida", "queensland", "samoa", "fiji", "papua new guinea", "supermarket", "grocery store",
    "backyard garden", "patio", "lawn",
)
LANGUAGE_STOPWORDS = {
    "en": (
        "the", "and", "of", "to", "is", "are", "with", "for", "that", "this", "from", "be", "have", "which", "can", "should",
    ),
    "fr": (
        "les", "des", "une", "dans", "pour", "sur", "avec", "est", "sont", "cette", "aux", "par", "plus", "leur", "être", "nous",
    ),
    "es": (
        "los", "las", "una", "para", "con", "por", "que", "del", "como", "más", "este", "son", "ser", "está",
    ),
    "pt": (
        "dos", "das", "uma", "para", "com", "por", "que", "não", "mais", "como", "são", "está", "pelo",
    ),
}

# Re-ranking.
RESEARCH_REGISTER = (
    r"(?i)\b(?:standard operating procedure|in vitro|germplasm|genebank|gene bank|accessions?|screen ?house|tissue culture|"
    r"randomi[sz]ed complete block|research protocol)\b"
)
POSTHARVEST_TERMS = (
    r"(?i)\b(?:storage|storing|stored|store|stores|drying|dried|dry(?:ing)? floor|moisture content|bagging|bagged|warehouse|"
    r"shelf ?life|threshing|winnow\w*|silo|crib|post-?harvest|packaging|hermetic|tarpaulin)\b"
)
FIELD_CONTEXT = (
    r"(?i)\b(?:leaf|leaves|vine|stem|flower\w*|seedling|plant\w*|field|shoot|root|panicle|tassel|cob|branch|foliage|grow\w*|"
    r"germinat\w*|pod|tuber|sett|sucker|node|tip|whorl|silk|husk|crown|runner|canopy|stand|nursery|transplant\w*|till\w*|"
    r"head)s?\b"
)
STORE_CONTEXT = (
    r"(?i)\b(?:store|stored|storing|storage|barn|crib|warehouse|silo|bag|bags|sack|sacks|after harvest|post-?harvest|market|"
    r"selling|sell|transport|shelf)\b"
)

# Scope rules.
IN_SCOPE_CROPS = (
    "cassava", "maize", "yam", "tomato", "rice", "cowpea", "groundnut", "pepper", "okra",
)
OUT_OF_SCOPE_CROPS = {
    "cocoa": "cocoa", "cacao": "cocoa", "sorghum": "sorghum", "millet": "millet", "cotton": "cotton", "oil palm": "oil palm", "plantain": "plantain",
    "banana": "banana", "sugarcane": "sugarcane", "coffee": "coffee", "cashew": "cashew", "soya": "soyabean", "soybean": "soyabean",
    "sweet potato": "sweet potato", "cocoyam": "cocoyam", "wheat": "wheat", "sesame": "sesame", "pineapple": "pineapple", "watermelon": "watermelon",
    "mango": "mango", "papaya": "papaya", "pawpaw": "papaya", "avocado": "avocado", "citrus": "citrus", "orange tree": "citrus",
    "cucumber": "cucumber", "onion": "onion", "cabbage": "cabbage", "carrot": "carrot", "lettuce": "lettuce", "spinach": "spinach",
}
DOSAGE_QUESTION = (
    r"(?i)\b(?:how (?:much|many|strong|concentrated)|what[^?]{0,20}?(?:dose|dosage|rate|amount|quantity|concentration|volume|"
    r"amount|strength)|exactly how|dos(?:e|age)s?|(?:mixing |dilution |application )?ratio|\brates?\b|per (?:litre|liter|"
    r"hectare|acre|knapsack|tank)|how many (?:ml|millilitres|milliliters|grams?|litres?|liters?|cc|spoons?|caps?))\b"
)
SUBSTANCE = (
    r"(?i)\b(?:pesticide|insecticide|fungicide|herbicide|acaricide|nematicide|chemical|spray|antibiotic|antibiotics|drug|"
    "medicine|dewormer|anthelmintic|vaccine|injection|inject|dose|dosage|powder|granule|solution|mixture|formulation|"
    "round-?up|gramoxone|karate|dursban|ivermectin|albendazole|levamisole|oxytetracycline|tetracycline|penicillin|amprolium|"
    "tylosin|closantel|praziquantel|glyphosate|paraquat|atrazine|mancozeb|chlorpyrifos|cypermethrin|lambda[- ]?cyhalothrin|"
    r"imidacloprid|carbofuran|metalaxyl|emamectin|abamectin|deltamethrin|dimethoate|profenofos)\b"
)
PRICE_METHOD = r"(?i)^\s*(?:how (?:do|can|should) i|where (?:can|do|should) i|why (?:do|does|are|is)|what makes|how are|how is)\b"
LIVE_PRICE = (
    r"(?i)\b(?:what(?:'s| is) the (?:current |today'?s? )?price|how much (?:is|does|are|do|be)[^?]*(?:cost|sell|selling|"
    "go(?:ing)? for)|how much be [^?]{0,30}(?:bag|basket|tonne|kg|kilo|crate|tuber|bunch|maize|corn|cassava|yam|rice|garri|"
    "tomato|pepper|okra|beans?|cowpea)|price (?:of|for)[^?]*(?:today|now|currently|this week)|(?:current|today'?s?|latest|"
    r"market) price|(?:what|how much)[^?]{0,60}\bsell(?:s|ing)? (?:for|at)\b|\bsell(?:s|ing)? (?:for|at)\b[^?]{0,40}(?:today|"
    "now|currently|this week)|(?:pay|paying|paid|buying|bought|fetch(?:ing)?)[^?]{0,30}(?:bag|basket|tonne|kg|kilo|crate|"
    "tuber|bunch)|what (?:do|are)[^?]{0,40}(?:traders?|buyers?|market|people|they)[^?]{0,20}(?:pay|paying|offer)|"
    r"\bfetch(?:ing|es)?\b[^?]{0,30}(?:market|price|now|today|per)|(?:expect|hope) to (?:get|make|receive)[^?]{0,30}(?:per|"
    "for|bag|basket|kg|tonne)|(?:what|how much)[^?]{0,40}(?:price|worth|cost)|how much[^?]{0,20}(?:go|will|would) sell|"
    "(?:for|at) how much|price (?:of|for|per)|(?:fair|good|right|current|best) price|what will i (?:get|make|earn)|(?:how "
    "much|what)[^?]{0,20}per (?:kilo|kg|tonne|ton|bag|basket|crate)|cost of (?:a|an|one|the)?[^?]{0,20}(?:bag|kilo|kg|tonne|"
    "litre|crate|basket)|(?:current|going|market) rate (?:for|of)|what (?:should|do) i charge|what would i (?:get|make|earn)|"
    "(?:people|they|traders|buyers) (?:are )?paying for|how much (?:is|are|was|were)[^?]{0,25}(?:these days|now|today|"
    "currently|nowadays|this season)|ballpark|rough(?:ly)? figure|what.{0,12}(?:it|they) worth|(?:value|valuing) my|how "
    r"much.{0,20}(?:value|valued)|(?:\d[\d, ]*|(?:one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|fifty|"
    r"hundred)\s+)+(?:thousand|million|naira|k)\b[^?]{0,30}(?:reasonable|fair|good|right|too much|too little|ok)|how much "
    "(?:money|profit|income)|how much (?:is|are|does|do|will|would|can|could|should)[^?]{0,40}(?:cost|worth|sell|fetch|get|"
    r"make|pay)|what (?:are|is) [^?]*going for)\b"
)
LIVE_FORECAST = (
    r"(?i)\b(?:(?:will|going to|gonna)[^?]{0,40}(?:rain|rains|raining|harmattan|flood|drought|dry spell|storm)|(?:is|"
    "are)[^?]{0,20}going to[^?]{0,20}(?:rain|rains|harmattan|flood|drought|dry spell|storm)|(?:rain|rains|harmattan|flood|"
    r"drought|dry spell|storm)[^?]{0,30}(?:will|going to|gonna)|(?:rain|rains|harmattan|flood|drought)\s+go\s+\w+|"
    r"\bgo\s+(?:rain|fall)\b|(?:rain|rains|harmattan|flood|drought|dry spell|storm)[^?]{0,25}(?:next week|next month|next "
    "season|tomorrow|this week|coming)|(?:next week|next month|next season|tomorrow)[^?]{0,25}(?:rain|rains|harmattan|flood|"
    "drought|dry spell)|when will (?:it|the rains?) (?:rain|come|start|stop|end)|(?:expect|anticipate)[^?]{0,30}(?:rain|dry "
    "spell|drought|flood|harmattan|storm)|outlook for the (?:season|year|rains)|(?:dry|wet|rainy) season[^?]{0,20}(?:coming|"
    r"arriv|start|early|late)|(?:good|bad|wet|dry) (?:year|season)\?\s*(?:ahead|coming|expected)|(?:how many days|how long|"
    r"when)[^?]{0,25}(?:until|till|before|is)[^?]{0,20}rains?\b|next rain\w*|weather[^?]{0,25}(?:next week|next month|"
    r"tomorrow|this week|do|be like)|will there be[^?]{0,25}(?:rain|flood|drought|dry spell|storm)\w*|(?:weather )?forecast)\b"
)
HUMAN_MEDICAL_PERSON = (
    r"(?i)\b(?:i feel|i am feeling|i'?m feeling|my head|my eyes|my skin|what tablet|what drug should i|my child|my children|"
    r"my wife|my husband|my baby|for myself|on myself|\bwhat (?:should|can) i take)\b"
)
HUMAN_MEDICAL_SYMPTOM = (
    r"(?i)\b(?:dizzy|dizziness|vomit\w*|nausea\w*|headache|breathing|breathe|poisoned|swallowed|fainted|rash|my (?:back|chest|"
    r"throat|stomach|hands?|arms?|legs?))\b"
)
FINANCIAL_LEGAL = (
    r"(?i)\b(?:banks?\b|loans?\b|microfinance\b|collateral\b|mortgages?\b|credit facilit\w*|interest rates?\b|insur\w*|land "
    r"titles?\b|title deeds?\b|land registr\w*|farmland title\w*|deed of assignment\b|certificate of occupancy\b|register "
    r"(?:my |the )?(?:farm|land)\w*|taxe?s?\b|levy\b|levies\b|subsidy applicat\w*|grant applicat\w*|cooperative registrat\w*|"
    r"business registrat\w*|licence applicat\w*)"
)
MACHINE = (
    r"(?i)\b(?:engine|motor|motorcycle|motorbike|okada|generator|genset|pump|tractor|tiller|mill|grinder|machine|machinery|"
    r"gearbox|carburettor|carburetor|battery|alternator|spark plug|sprayer|knapsack|nozzle|pressure gauge|hose|blade|blades)\b"
)
MECHANICAL_FAULT = (
    r"(?i)\b(?:fix|repair|repairing|mend|service|servicing|overhaul|(?:will|would|does|do|is|are)\s*n[o']?t\s*(?:start|"
    "starting|run|running|work|working|turn|move)|broken|broke down|breaking down|stopped working|not starting|won'?t start|"
    r"fault|faulty|leaking oil|smoking|build(?:ing)? pressure|no pressure|lose[sd]? pressure|blocked|clogg\w*|worn|blunt|dull|"
    r"jammed|stuck|dripping|making (?:a )?(?:noise|sound)|strange (?:noise|sound)|knocking|rattling)\b"
)
HARM_TO_OTHERS = (
    r"(?i)\b(?:poison|kill|harm|hurt|destroy|damage|burn|injure|maim|sicken)\w*[^?.!]{0,40}\b(?:neighbou?r|someone else|"
    r"somebody else|rival|competitor|another (?:farmer|man|woman|person)|(?:his|her|their)\s+(?:goat|sheep|cow|cattle|chicken|"
    r"fowl|bird|animal|crop|farm|field|maize|cassava|yam|tomato|rice|harvest)s?)\b|\b(?:neighbou?r|rival|competitor|another "
    r"(?:farmer|man|woman|person))\w*[^?.!]{0,40}\b(?:poison|kill|harm|hurt|destroy|damage|burn|injure)\w*"
)
DECEIVE_BUYER = (
    r"(?i)\b(?:look|looks|looking|seem|seems|appear|appears)\s+(?:fresh\w*|new\w*|bigger|heavier|better|healthy|ripe\w*)|"
    r"\b(?:hide|hiding|disguise|disguising|cover up|conceal|mask)\w*[^?.!]{0,40}(?:rot|rotten|spoil\w*|damage\w*|mould|mold|"
    r"disease\w*|weevil|infest\w*)|\b(?:trick|deceive|fool|cheat|swindle)\w*[^?.!]{0,30}(?:buyer|customer|trader|market|"
    "inspector)"
)
ADULTERATE = (
    r"(?i)\b(?:add|adding|mix|mixing|put|putting|soak|soaking)\w*\s+(?:in\s+|some\s+)?(?:water|sand|stone|stones|gravel|dust|"
    r"chalk|salt|sawdust|powder)\b[^?.!]{0,40}(?:grain|maize|rice|garri|bag|produce|sell|weigh|sack)|\b(?:weigh|weighs|"
    r"weight)\w*\s+more\b[^?.!]{0,40}(?:sell|selling|sale|buyer|market)|\bmake\b[^?.!]{0,30}\bheav(?:y|"
    r"ier)\b[^?.!]{0,30}(?:sell|selling|sale|buyer|market)"
)
EVADE_PROHIBITION = (
    r"(?i)\b(?:banned|illegal|prohibited|outlawed|restricted)\b[^?.!]{0,30}\b(?:but|still|anyway|works|effective|best|use "
    r"it)\b|\bwithout\s+(?:getting\s+caught|being\s+caught|anyone\s+knowing|detection)|\b(?:avoid|evade|dodge|get\s+around|"
    r"bypass)\w*\s+(?:the\s+)?(?:inspector|inspection|regulation|authorit\w+|law)"
)
ELSEWHERE = (
    r"(?i)\b(?:scotland|england|britain|uk|ireland|wales|europe|america|usa|canada|australia|india|china|brazil|mexico|"
    "philippines|indonesia|vietnam|thailand|kenya|kenyan|uganda|ugandan|tanzania|tanzanian|ethiopia|ethiopian|malawi|"
    "malawian|zambia|zambian|zimbabwe|south africa|ghana|ghanaian|senegal|mali|niger republic|cameroon|ivory coast|c[oô]te "
    r"d'ivoire|benin republic)\b"
)
HERE = (
    r"(?i)\b(?:nigeria|nigerian|oyo|ogun|osun|ondo|ekiti|lagos|ibadan|abeokuta|ilorin|akure|ilesha|ogbomoso|abuja|kano|kaduna|"
    r"enugu|south ?west)\b"
)
WRONG_CLIMATE = r"(?i)\b(?:frost|frosts|frozen|snow|snowfall|winter|sub-?zero|permafrost|hail ?storm)\b"
LIFE_DECISION = (
    r"(?i)\b(?:should i (?:become|be|remain|continue as|stop being|stop|quit|give up|leave|abandon)[^?]{0,20}(?:a "
    r")?(?:farm\w*|farming|agriculture)|(?:is|would) farming (?:worth|right|good|a good|profitable) (?:it|for me)|should i "
    "(?:expand|grow|scale|enlarge)[^?]{0,15}(?:my )?(?:farm|business)|is it worth (?:it )?(?:to )?(?:farm|farming|continuing|"
    "carrying on)|should i keep farming|what should i do with my (?:life|future)|is there (?:any )?(?:point|future) in "
    r"(?:farming|continuing|this))\b"
)
IN_DOMAIN = (
    r"(?i)\b(?:cassava|maize|corn|yam|tomato(?:es)?|rice|cowpea|beans?|groundnut|peanut|pepper|chilli|okra|okro|goat|kid|"
    "sheep|lamb|ram|ewe|cattle|cow|calf|calves|bull|chicken|hen|cockerel|fowl|bird|chick|poultry|broiler|layer|livestock|"
    r"herd|flock|animal|farm\w*|crop|harvest\w*|plant\w*|sow\w*|seed\w*|seedling|weed\w*|fertili[sz]\w*|manure|compost|soil|"
    r"land|field|plot|ridge|mulch\w*|irrigat\w*|water\w*|drain\w*|rain\w*|season|drought|dry spell|storm|harmattan|flood|pest|"
    r"insect|disease|fungus|fungal|virus|bacteri\w*|rot|blight|mildew|wilt\w*|mosaic|streak|spray\w*|pesticide|herbicide|"
    r"insecticide|yield|stunt\w*|germinat\w*|prun\w*|graft\w*|nursery|store|storage|silo|barn|crib|dry\w*|mould|mold|weevil|"
    r"graz\w*|fodder|forage|feed\w*|dewor\w*|vaccin\w*|milk\w*|market|buyer|sell\w*|extension officer|agronom\w*|control|"
    r"organic|chemical|method|practice|technique|variety|varieties|cultivar|rotat\w*|intercrop\w*|spacing|density|tillage|"
    r"ridge|husbandry|breed\w*|cull\w*|hatch\w*|brood\w*|litter|nutrient|nitrogen|phosphor\w*|potass\w*|npk|urea|lime|acid\w*|"
    r"erosion|shade|canopy|thin\w*|transplant\w*|striga|witchweed|armyworm|stemborer|nematode|aphid|thrip|mite|whitefly|"
    "mealybug|leafminer|cutworm|weevil|borer|termite|protective|overall|goggle|glove|mask|respirator|boot|apron|knapsack|"
    r"sprayer|nozzle|applicat\w*|label|expir\w*|record\w*|planning|calendar|budget\w*|withdrawal|withhold\w*|residue|"
    r"container|drum|bucket|spoon|mixture|powder|granule|solution|dilut\w*|garri|gari|flour|starch|chip|peel|weather|flood\w*|"
    r"erosion|humid\w*|temperature|round-?up|glyphosate|paraquat|mancozeb|cypermethrin|carbofuran|endosulfan|monocrotophos|"
    "ivermectin|albendazole|levamisole|npk|fertili[sz]er|urea|potash|moisture meter|scale|weighing|tarpaulin|sack|silo|hoe|"
    r"cutlass|machete|wheelbarrow|watering can|shade net|nursery tray|thresher|sheller)s?\b"
)
NEVER_IN_DOMAIN = (
    r"(?i)\b(?:president|governor|election|politic\w*|minister|parliament|football|world cup|capital of|translate|python|"
    r"javascript|multiplied by|divided by|square root|catfish|tilapia|fish ?pond|aquacultur\w*|bee ?hive|beekeep\w*|honey|dog|"
    r"cat|rabbit|snail|mushroom|timber|firewood)\b"
)

# Refusal texts of the scope rules, and fixed texts of answers.
FINANCIAL_LEGAL_MESSAGE = (
    "I cannot advise on loans, land titles or registration. My documents are agricultural guidance - crops, livestock, "
    "weather and markets - and answering from them would mean guessing about your money or your land. Please ask your bank, "
    "your local land registry, or your extension officer, who can refer you."
)
MECHANICAL_MESSAGE = (
    "I cannot help with repairing machinery. My documents are agricultural guidance - crops, livestock, weather and markets "
    "- and they contain no repair instructions, so anything I said about your engine would be guesswork. Please ask a "
    "mechanic. If your question is about using or calibrating farm equipment rather than repairing it, ask me again that way."
)
DOSAGE_MESSAGE = (
    "I cannot tell you how much to use. The correct amount depends on the specific product, its concentration, and what is "
    "registered for your crop or animal - none of which is in my documents. Read the product label, or ask your extension "
    "officer or veterinary officer. Guessing a dose can harm your crop, your animals, or you."
)
HUMAN_MEDICAL_MESSAGE = (
    "This sounds like it may affect your health, and I only give advice about crops and livestock. If you feel unwell after "
    "handling farm chemicals, stop work, wash thoroughly, and go to a clinic or hospital now. Take the product container "
    "with you so they know what you were exposed to."
)
HARMFUL_MESSAGE = "I am sorry, but I cannot help with that."
NO_GUIDANCE_FALLBACK = (
    "I only answer questions about growing the crops and keeping the animals in my documents. Please ask your local "
    "extension officer about anything else."
)
OUT_OF_AREA_MESSAGE = (
    "My documents are for smallholder farming in southwest Nigeria, so I cannot give reliable advice for another country or "
    "climate. Please ask an extension officer where you are farming."
)
LIVE_PRICE_MESSAGE = (
    "I cannot tell you today's price - my documents are guides, not a market report, and prices change every day. I can help "
    "you decide WHEN to sell, how to store your crop so it keeps its value, and how grading affects what you are offered. "
    "For today's price, ask at the market or call a trader you trust."
)
LIVE_FORECAST_MESSAGE = (
    "I cannot tell you what the weather will do - I have no forecast, only farming guides. I can help you decide when the "
    "rains have truly established, what to do if a dry spell comes, and how to prepare a field that floods. For a forecast, "
    "listen to the radio or check with your extension officer."
)
LIFE_DECISION_MESSAGE = (
    "That is a decision about your own situation - your land, your money, your family - and my documents only cover growing "
    "crops and keeping animals. I cannot weigh those for you. Please talk it through with your extension officer or your "
    "cooperative, who know your circumstances."
)
NO_GUIDANCE_MESSAGE = (
    "I do not have local guidance on that in my documents, so I cannot give you a reliable answer. Please ask your local "
    "extension officer."
)
MESSAGES = {
    "en": {
        "no_guidance": (
            "I do not have local guidance on that in my documents, so I cannot give you a reliable answer. Please ask your local "
            "extension officer."
        ),
        "hazardous_pesticide": (
            "Some sources mention pesticides that are banned or severely restricted in many countries. Do not use them. Ask your "
            "local extension officer which products are currently registered for your crop."
        ),
        "unsupported_dosage": (
            "This answer contained application rates that are not stated in the source documents, so they have been removed. Never "
            "guess a dose - ask an extension officer or read the product label."
        ),
        "stale_chemical": (
            "Chemical control guidance here comes from older documents. Pesticide registrations change; confirm with an extension "
            "officer before applying anything."
        ),
        "dosage_refusal": (
            "I cannot tell you how much to use. The correct amount depends on the specific product and what is registered for your "
            "crop or animal. Read the product label, or ask your extension officer."
        ),
        "withdrawal_period": (
            "IMPORTANT: after treating an animal with medicine, there is a withdrawal period before its milk or meat is safe for "
            "people to consume. Ask a veterinary officer how long to wait before selling or drinking the milk, or slaughtering the "
            "animal."
        ),
        "human_medical": (
            "If you feel unwell after handling farm chemicals, stop work, wash thoroughly, and go to a clinic or hospital now. Take "
            "the product container with you so they know what you were exposed to."
        ),
        "out_of_scope_crop": (
            "I do not cover that crop. My documents are about cassava, maize, yam, tomato, rice, cowpea, groundnut, pepper and okra, "
            "and about livestock. Please ask your extension officer."
        ),
        "live_forecast": (
            "I cannot tell you what the weather will do - I have no forecast, only farming guides. I can help you decide when the "
            "rains have truly established, what to do if a dry spell comes, and how to prepare a field that floods. For a forecast, "
            "listen to the radio or check with your extension officer."
        ),
    },
    "pcm": {
        "no_guidance": (
            "I no get information about dis one for di book wey I get, so I no fit give you answer wey you fit trust. Abeg go meet "
            "your extension officer."
        ),
        "hazardous_pesticide": (
            "Some of di medicine wey dis book talk about, plenty country don ban am. No use am at all. Ask your extension officer "
            "which one dem allow for your crop now."
        ),
        "unsupported_dosage": (
            "Di answer bin get quantity wey no dey inside di book, so I comot am. Never guess how much you go use - ask extension "
            "officer or read wetin dem write for di container."
        ),
        "stale_chemical": (
            "Dis advice about chemical come from old book. Di rule for pesticide dey change, so confirm with extension officer "
            "before you use anything."
        ),
        "dosage_refusal": (
            "I no fit tell you how much you go use. Di correct quantity depend on di particular product and wetin dem register for "
            "your crop or your animal. Read di label for di container, or ask your extension officer."
        ),
        "withdrawal_period": (
            "IMPORTANT: after you give animal medicine, e get time wey you must wait before di milk or di meat go safe for person to "
            "chop. Ask veterinary officer how many day you go wait before you sell am, drink di milk, or kill di animal."
        ),
        "human_medical": (
            "If your body no dey okay after you touch farm chemical, stop work, wash yourself well well, and go clinic or hospital "
            "now now. Carry di container go so dem go sabi wetin enter your body."
        ),
        "out_of_scope_crop": (
            "I no sabi about dat crop. Di book wey I get na about cassava, corn, yam, tomato, rice, beans, groundnut, pepper and "
            "okra, and about animal. Abeg ask your extension officer."
        ),
        "live_forecast": (
            "Omo, I not fit tell you anything on this one o. I no get any forecast. You fit listen for your radio or go ask your "
            "extension officer sha"
        ),
        "harmful_request": (
            "I no fit help you with dat, sorry."
        ),
        "live_price": (
            "I no fit yan you today price, my papers na guide dem be, no be market report, and price dey change every day. I fit "
            "help you sabi wen to sell, how you go store your crop make e no lose value, and how grading fit affect wetin dem go "
            "offer you. For today price, make you ask for market or hala trader wey you sabi trust."
        ),
        "financial_legal": (
            "I no fit yan you about loans, land titles or registration. My papers na about farm tins like crops, animals, weather, "
            "and market dem. If I start to answer from there, e go be like say I dey guess your money or your land. Abeg ask your "
            "bank, your local land registry, or your extension officer, dem fit refer you."
        ),
        "mechanical_repair": (
            "I no fit help fix machine dem. My papers na about farm tins like crops, animals, weather, and market dem, no be repair "
            "manual. So anything wey I talk about your engine na just my guess. Abeg, make you ask mechanic na. If na how to use or "
            "set farm machine you wan ask, no be how to fix am, make you ask me like that again."
        ),
        "personal_decision": (
            "Na your own matter be dat, your land, your money, your family. My papers na only for farming and animal keeping. I no "
            "fit weigh dem for you. Abeg yarn am well with your extension officer or your cooperative wey sabi your matter well well."
        ),
        "out_of_area": (
            "My papers na for small farm for southwest Naija, so I no fit give correct advice for another country or climate. Abeg, "
            "ask that extension officer wey dey your farm area."
        ),
        "out_of_domain": (
            "I dey answer only questions wey concern how to grow crops and take care of animals for my documents. Abeg, make you "
            "hala your local extension officer if you get any other gbege."
        ),
    },
}

# Safety rules.
HAZARDOUS_ACTIVES = (
    "ddt", "aldrin", "dieldrin", "endrin", "chlordane", "heptachlor", "lindane", "hch", "bhc", "toxaphene", "endosulfan", "hexachlorobenzene",
    "pentachlorophenol", "parathion", "methyl parathion", "parathion-methyl", "monocrotophos", "methamidophos", "phosphamidon", "dichlorvos", "ddvp",
    "disulfoton", "phorate", "terbufos", "fenamiphos", "ethoprophos", "sulfotep", "azinphos-methyl", "methidathion", "triazophos", "omethoate",
    "dicrotophos", "coumaphos", "edifenphos", "mecarbam", "thiometon", "vamidothion", "isoxathion", "isazofos", "famphur", "cadusafos",
    "chlorethoxyfos", "chlormephos", "heptenophos", "propetamphos", "oxydemeton-methyl", "tepp", "epn", "aldicarb", "carbofuran", "methomyl",
    "methiocarb", "oxamyl", "formetanate", "furathiocarb", "thiofanox", "carbaryl", "paraquat", "captafol", "binapacryl", "dinoseb", "dinoterb",
    "dnoc", "fluoroacetamide", "sodium fluoroacetate", "sodium arsenite", "sodium cyanide", "lead arsenate", "paris green", "zinc phosphide",
    "mercuric chloride", "mercuric oxide", "phenylmercury acetate", "methyl bromide", "ethylene dibromide", "alachlor", "tributyltin", "brodifacoum",
    "warfarin", "nicotine", "flucythrinate", "chlorpyrifos", "chlorpyrifos-methyl", "mancozeb", "maneb", "zineb", "thiram", "ziram", "propineb",
    "atrazine", "diuron", "linuron", "chlorothalonil", "iprodione", "procymidone", "vinclozolin", "carbendazim", "benomyl", "thiophanate-methyl",
    "fipronil", "imidacloprid", "clothianidin", "thiamethoxam", "acetamiprid", "dimethoate", "malathion", "profenofos", "quinalphos", "fenthion",
)
DOSAGE_PATTERNS = (
    r"(?i)\b\d+(?:[.,]\d+)?\s*(?:millilitres?|milliliters?|litres?|liters?|kilograms?|kilogrammes?|milligram(?:me)?s?|grammes?|grams?|teaspoons?|tablespoons?|tablets?|capsules?|sachets?|boluses|bolus|scoops?|drops?|caps?|ml|mls|cc|mg|kg|g|l|oz|lb|tsp|tbsp|iu|ppm)\b[^.]{0,24}?\s*(?:per|/|every)\s*(?:\d+(?:[.,]\d+)?\s*)?(?:hectares?|acres?|plants?|trees?|stands?|square\s+metres?|litres?|liters?|gallons?|ha|m2|l|kilogram(?:me)?s?|kg|body\s*weight|bw|animals?|birds?|heads?|goats?|sheep|cows?|cattle|calf|calves|chickens?|hens?|chicks?|pigs?|rams?|ewes?|bucks?|knapsacks?|sprayers?|tanks?|drums?|buckets?|rows?|holes?|mounds?|bags?|seeds?|cuttings?|days?|weeks?|doses?|treatments?)(?:\s*body\s*weight)?\b",
    r"(?i)\b\d+(?:[.,]\d+)?\s*(?:millilitres?|milliliters?|litres?|liters?|kilograms?|kilogrammes?|milligram(?:me)?s?|grammes?|grams?|teaspoons?|tablespoons?|tablets?|capsules?|sachets?|boluses|bolus|scoops?|drops?|caps?|ml|mls|cc|mg|kg|g|l|oz|lb|tsp|tbsp|iu|ppm)\b[^.]{0,30}?\bin\b[^.]{0,20}?\b\d+(?:[.,]\d+)?\s*(?:litres?|liters?|gallons?|l)\b",
    r"(?i)\b(?:give|gives|giving|given|administer|administers|administered|inject|injects|injected|injection|drench|drenches|drenched|dose|doses|dosed|dosing|apply|applies|applied|application|spray|sprays|sprayed|mix|mixes|mixed|add|adds|added|use|uses|using|treat|treats|treated|dissolve|dissolves|dilute|dilutes)\b[^.]{0,25}?\b(?<dose>\d+(?:[.,]\d+)?\s*(?:millilitres?|milliliters?|litres?|liters?|kilograms?|kilogrammes?|milligram(?:me)?s?|grammes?|grams?|teaspoons?|tablespoons?|tablets?|capsules?|sachets?|boluses|bolus|scoops?|drops?|caps?|ml|mls|cc|mg|kg|g|l|oz|lb|tsp|tbsp|iu|ppm))\b(?!\s*(?:of\s+)?(?:bags?|sacks?|body\s*weight|goats?|cows?|sheep|cattle|animals?|birds?|chickens?|hens?|tubers?|baskets?|crates?|drums?|buckets?|containers?|bottles?|jerry\s*cans?)\b)",
    r"(?i)\b(?:dilut|ratio|mix)\w*[^.]{0,25}?\b\d+\s*:\s*\d+\b", r"(?i)\b\d+(?:[.,]\d+)?\s*%\s*(?:solution|concentration|a\.i\.|active)",
)
CHEMICAL_CONTEXT = (
    r"(?i)\b(?:pesticide|insecticide|fungicide|herbicide|nematicide|acaricide|spray|spraying|chemical control|active "
    r"ingredient|formulation|dose|dosage|apply\w*\s+(?:at|the rate)|rate of application)\b"
)
VETERINARY_TREATMENT = (
    r"(?i)\b(?:antibiotic|antibiotics|oxytetracycline|tetracycline|penicillin|streptomycin|sulphonamide|sulfonamide|tylosin|"
    "enrofloxacin|anthelmintic|dewormer|deworming|albendazole|levamisole|ivermectin|fenbendazole|acaricide|dip|drench|"
    r"injectable|vaccinate|vaccination|trypanocide|diminazene|isometamidium)\b"
)
WITHDRAWAL_QUESTION = (
    r"(?i)\b(?:(?:when|how long|how soon)[^?]{0,60}(?:sell|drink|eat|consume|slaughter|market)[^?]{0,30}(?:milk|meat|egg|bird|"
    r"chicken|goat|cow|animal)|(?:milk|meat|eggs?)[^?]{0,40}(?:after|following)[^?]{0,30}(?:treat\w*|inject\w*|dos\w*|"
    "medicine|drug)|(?:can|should|may) (?:i|we)[^?]{0,20}(?:drink|eat|consume|sell)[^?]{0,30}(?:milk|meat|eggs?)|(?:safe|"
    "alright|ok)[^?]{0,30}(?:to )?(?:drink|eat|consume|sell)[^?]{0,30}(?:milk|meat|egg)|(?:treated|"
    r"medicated)[^?]{0,20}(?:animal|goat|cow|chicken|bird|milk|meat))\b"
)
WITHDRAWAL_MENTIONED = (
    r"(?i)\b(?:withdrawal period|withdrawal time|withholding period|do not (?:drink|consume|sell) (?:the )?milk|milk "
    r"withdrawal|meat withdrawal|residue)\b"
)
RESTRICTED_VETERINARY = (
    "chloramphenicol", "nitrofuran", "nitrofurans", "furazolidone", "dimetridazole", "metronidazole", "ronidazole", "clenbuterol",
    "diethylstilbestrol", "stilbenes", "phenylbutazone",
)
FOREIGN_MONEY = (
    r"(?i)(?<![A-Za-z])([$£€](?=\s*\d)|[KUT]?\.?Sh(?:s|illing)?\.?(?=\s*\d)|KES|TZS|UGX|ZMW|MWK|GH\.?S|XOF|XAF|ZAR|USD|"
    r"(?:kenyan|tanzanian|ugandan|zambian|malawian|ghanaian|south african)\s+(?:shillings?|kwacha|cedis?|rand)|shillings?|"
    "kwacha|cedis?)(?![A-Za-z])"
)
MONEY = (
    r"(?i)(?:(?:(?:US|U\.S\.|AU|CA|NZ|HK|SG|NT)?[$£€₦]|(?:[KUT]?\.?Shs?|KES|KSH|TZS|UGX|ZMW|ZMK|MWK|RWF|ETB|BIF|SOS|SDG|SSP|"
    "CDF|AOA|GHS|GHC|XOF|XAF|GNF|GMD|LRD|SLL|SLE|CVE|STN|MZN|BWP|NAD|ZAR|LSL|SZL|EGP|MAD|DZD|TND|LYD|MUR|SCR|MGA|KMF|DJF|ERN|"
    r"NGN|USD|EUR|GBP|CNY|JPY|INR|CHF|CAD|AUD)|\bN)\s*\d[\d,.]*|\d[\d,.]*\s*(?:(?:US|U\.S\.|AU|CA|NZ|HK|SG|NT)?[$£€₦]|"
    r"(?:[KUT]?\.?Shs?|KES|KSH|TZS|UGX|ZMW|ZMK|MWK|RWF|ETB|BIF|SOS|SDG|SSP|CDF|AOA|GHS|GHC|XOF|XAF|GNF|GMD|LRD|SLL|SLE|CVE|"
    r"STN|MZN|BWP|NAD|ZAR|LSL|SZL|EGP|MAD|DZD|TND|LYD|MUR|SCR|MGA|KMF|DJF|ERN|NGN|USD|EUR|GBP|CNY|JPY|INR|CHF|CAD|AUD))(?!\w)|"
    r"\d[\d,.]*\s*(?:(?:kenyan|ghanaian|nigerian|ugandan|tanzanian|zambian|malawian|rwandan|ethiopian|south african|american|"
    r"us|west african|central african)?\s*(?:naira|kobo|dollars?|cents?|pounds?|euros?|shillings?|kwacha|cedis?|rand|francs?|"
    r"birr|dalasis?|leones?|kwanzas?|meticals?|pulas?|dirhams?))\b)"
)
#: What stands for a dose that the sources lack: in a whole answer, and in one that streams (fixed values).
DOSE_REMOVED = "[rate not stated in sources - ask an extension officer]"
DOSE_GONE = "[rate not given in the sources - ask an extension officer]"
MONEY_REDACTION = "[this system has no price data - ask at your local market]"
REUSE_CONTAINER = (
    r"(?i)\b(?:re-?use|reusing|use|using|keep|store|fill)\w*\s+(?:the\s+|an?\s+|empty\s+|old\s+){0,3}(?:pesticide|chemical|"
    r"agrochemical|herbicide|insecticide)\s+(?:container|containers|drum|drums|can|cans|bottle|bottles|jerr?y ?can)|"
    r"\b(?:container|containers|drum|drums|bottle|bottles|jerr?y ?can)s?[^.!?]{0,40}?\b(?:hold|holding|store|storing|carry|"
    r"carrying|keep|keeping|fetch|fetching|for|to)\s+(?:\w+\s+){0,2}(?:water|drinking|food|grain|milk|palm ?oil)"
)
NEGATED = r"(?i)\b(?:not|never|don'?t|do not|avoid|should not|must not|no)\b"
CONTAINER_REUSE_WARNING = (
    "NEVER reuse a pesticide container for water, food or drink. Residue stays in the container and has poisoned whole "
    "households. Puncture empty containers and bury them away from water, or return them to the dealer."
)

# Answer cleaners and guards.
MONEY_MARK = (
    r"(?i)(?:US|U\.S\.|AU|CA|NZ|HK|SG|NT)?[$£€₦]|\bN(?=[\d,])|\b(?:(?:[KUT]?\.?Shs?|KES|KSH|TZS|UGX|ZMW|ZMK|MWK|RWF|ETB|BIF|"
    "SOS|SDG|SSP|CDF|AOA|GHS|GHC|XOF|XAF|GNF|GMD|LRD|SLL|SLE|CVE|STN|MZN|BWP|NAD|ZAR|LSL|SZL|EGP|MAD|DZD|TND|LYD|MUR|SCR|MGA|"
    r"KMF|DJF|ERN|NGN|USD|EUR|GBP|CNY|JPY|INR|CHF|CAD|AUD))\b|\b(?:(?:naira|kobo|dollars?|cents?|pounds?|euros?|shillings?|"
    r"kwacha|cedis?|rand|francs?|birr|dalasis?|leones?|kwanzas?|meticals?|pulas?|dirhams?))\b"
)
TIME_DEPENDENT = (
    r"(?i)\b(?:now|today|tonight|this (?:week|month|season)|right now|currently|at the moment|already|yet|these days|next "
    r"(?:week|month|season))\b"
)
FALSE_DISCLAIMER = (
    r"(?i)^\s*(?:i (?:do not|don't|dont) have (?:any )?(?:local |specific )?(?:guidance|information|data|details)[^.]*\.|i "
    r"have no (?:local |specific )?(?:guidance|information|data)[^.]*\.|(?:unfortunately|sadly)[^.]*(?:no|"
    r"not)[^.]*(?:guidance|information)[^.]*\.|(?:the|these) sources? (?:do not|don't) (?:contain|provide|mention)[^.]*\.)\s*"
)
ECHO_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "do", "does", "for", "from", "had", "has", "have", "how", "i",
    "if", "in", "into", "is", "it", "its", "me", "my", "of", "on", "or", "our", "should", "so", "that", "the", "their", "them", "then", "there",
    "these", "they", "this", "to", "too", "very", "was", "were", "what", "when", "where", "which", "who", "will", "with", "you", "your",
)
IMPERATIVE = (
    r"(?i)^\s*(?:for [^,]{1,30},\s*)?(?:you (?:should|must|can|need to)\s+)?(?:cut|remove|uproot|destroy|burn|bury|apply|"
    "spray|plant|sow|harvest|store|sell|water|feed|treat|inject|collect|handpick|pick|rogue|prune|weed|dig|leave|keep|avoid|"
    r"stop|start|use|make|check|inspect|monitor)\b"
)
CITATION_RUN = r"^(?:\s*\[\d+\]\s*){2,}"
REGULATORY = (
    r"(?i)\bregistered\b|\bregistration\b|\bapproved\b|\bapproval\b|\blicen[cs]ed\b|\bbanned\b|\bban\b|\billegal\b|"
    r"\bpermitted\b"
)
JURISDICTION = r"(?i)\bnigeria\w*\b|\bnafdac\b|\bgovernment\b|\bofficial\w*\b|\bfor use\b|\bby law\b|\blegal\w*\b|\bauthorit\w+\b"
CLOSED_OPENER = r"(?i)^\s*(?:is|are|does|do|did|can|could|will|would|has|have|had|should|was|were)\b"

# Languages.
PIDGIN_STRONG = (
    "dey", "wey", "sabi", "abeg", "una", "dem", "comot", "wetin", "waka", "chop", "oga", "biko", "naim", "dis", "dat", "di", "pikin", "pickin",
    "belle", "yansh",
)
PIDGIN_WEAK = (
    "na", "don", "no", "go", "make", "fit", "well well", "now now", "plenty", "small small",
)
PIDGIN_UNAMBIGUOUS = (
    "dey", "wetin", "abeg", "wey", "sabi", "una", "comot", "waka", "oga", "biko", "naim", "pikin", "pickin", "yansh", "wan", "sef", "abi", "shebi",
    "kpatakpata",
)
PIDGIN_PHRASES = (
    "no gree", "go take", "make i", "for am", "for di", "for dem", "don get", "don begin", "don dey", "don start", "don come", "dey go", "dey come",
    "no be", "e be", "e dey", "e don", "wetin be", "how i go", "which one better", "make e", "how much be", "who be", "wey be", "na wetin",
    "e no be",
)
GO_FUTURE = (
    r"(?i)\bi go\s+(?!to\b|home\b|out\b|back\b|there\b|now\b|from\b|and\b|with\b|for\b|into\b|through\b|around\b|down\b|up\b|"
    r"first\b|straight\b|ahead\b)[a-z]{2,}\b"
)
DON_PERFECT = r"(?i)\bdon\s+[a-z]{2,}\b"
FIT_MODAL = (
    r"(?i)\bfit\s+(?:give|help|do|make|come|go|use|tell|show|sell|plant|grow|work|carry|born|chop|cure|kill|stop|start|enter|"
    r"reach|last)\b"
)
PIDGIN_WEAK_PHRASES = (
    "well well", "now now", "small small", "quick quick", "sharp sharp", "una own",
)
YORUBA_CHARS = (
    "ṣ",
)
IGBO_CHARS = (
    "ụ", "ị", "ṅ",
)
SHARED_CHARS = (
    "ẹ", "ọ",
)
HAUSA_CHARS = (
    "ɓ", "ɗ", "ƙ", "ƴ",
)
YORUBA_WORDS = (
    "bawo", "jowo", "gbogbo", "sugbon", "nitori", "agbado", "ninu", "pupo", "tabi", "ewure",
)
IGBO_WORDS = (
    "kedu", "gini", "anyi", "nke", "ihe", "ndi", "unu", "maka", "banyere", "akwukwo", "ewu", "oka",
)
HAUSA_UNAMBIGUOUS = (
    "akuya", "awaki", "shanu", "kaza", "kaji", "kiwo", "masara", "rogo", "dawa", "gero", "gona", "noma", "girbi", "abinci", "rawaya", "taki", "yaya",
    "sannu", "saboda", "domin",
)
HAUSA_WORDS = (
    "ina", "yaya", "kuma", "sannu", "yanzu", "kada", "domin", "saboda", "gona", "noma", "shuka", "girbi", "masara", "rogo", "dawa", "gero", "shanu",
    "akuya", "awaki", "kaza", "kaji", "ruwa", "kasa", "iri", "taki",
)
PIDGIN_RULES = (
    (r"\b(?:abi\s+)?make\s+i\b", "should I"),
    (r"\bwetin dey worry\b", "what is wrong with"),
    (r"\bwetin be\b", "what is"),
    (r"\bwetin\b", "what"),
    (r"\bhow far\b", "how is"),
    (r"\bno dey\b", "is not"),
    (r"\bnever\s+dey\b", "has not been"),
    (r"\bdem dey\b", "are"),
    (r"\be dey\b", "it is"),
    (r"\bi dey\b", "I am"),
    (r"\bdey\b", "is"),
    (r"\bgo\s+(?=[a-z]+\b)", "will "),
    (r"\bdon\b", "has"),
    (r"\bwan\b", "want to"),
    (r"\bfit\b", "can"),
    (r"\bdem\b", "their"),
    (r"\buna\b", "your"),
    (r"\bpikin\b", "young one"),
    (r"(?<!\bi )\bam\b", "it"),
    (r"\bdis\b", "this"),
    (r"\bdat\b", "that"),
    (r"\bchop\b", "eat"),
    (r"\bfowl\b", "chicken"),
    (r"\bsabi\b", "know"),
    (r"\babi\b", "or"),
    (r"\bbelle\b", "stomach"),
    (r"\bwaka\b", "walk"),
    (r"\bplenty\b", "many"),
    (r"\brotten\b", "rot"),
    (r"\bfarm land\b", "farmland"),
    (r"\bsoso\b", "only"),
    (r"\bnaim\b", "it is"),
    (r"\bna\b", "is"),
    (r"\bmake\b", "so that"),
)
PIDGIN_MARKERS = r"(?i)\b(?:dey|wetin|abeg|sabi|una|abi|naim|pikin|comot|waka|oga)\b|\bmake i\b"
FARM_TERMS = {
    "ewure": "goat", "obuko": "goat", "agbado": "maize", "oka yoruba": "maize", "ege": "cassava", "paki": "cassava", "gbaguda": "cassava",
    "isu": "yam", "adie": "chicken", "malu": "cattle", "agutan": "sheep", "ewe": "leaf", "ewebe": "vegetable", "eso": "fruit", "gbongbo": "root",
    "ofeefee": "yellow", "pupa": "red", "dudu": "black", "ile": "soil", "oko": "farm", "omi": "water", "ojo": "rain", "ajenirun": "pest",
    "arun": "disease", "kokoro": "insect", "gbin": "plant", "ikore": "harvest", "ajile": "fertiliser", "jeun": "eating", "aisan": "sick",
    "ku": "plant", "ra": "rot", "ewu": "goat", "oka": "maize", "akpu": "cassava", "jigbo": "cassava", "ji": "yam", "okuko": "chicken",
    "ehi": "cattle", "aturu": "sheep", "akwukwo": "leaf", "mkpuru": "seed", "mgborogwu": "root", "odo odo": "yellow", "odo": "yellow",
    "ojii": "black", "ala": "soil", "ubi": "farm", "mmiri": "water", "mmiri ozuzo": "rain", "oria": "disease", "ahuhu": "pest", "ijiji": "fly",
    "iri nri": "eating", "eri nri": "eating", "eto": "grow", "owuwe": "harvest", "fatilaiza": "fertiliser", "akuya": "goat", "awaki": "goat",
    "bunsuru": "goat", "masara": "maize", "rogo": "cassava", "doya": "yam", "dawa": "sorghum", "gero": "millet", "shinkafa": "rice",
    "kaza": "chicken", "kaji": "chicken", "shanu": "cattle", "tumaki": "sheep", "ganye": "leaf", "iri": "seed", "saiwa": "root", "rawaya": "yellow",
    "ja": "red", "baki": "black", "kasa": "soil", "gona": "farm", "ruwa": "water", "ruwan sama": "rain", "cuta": "disease", "kwari": "insect",
    "kwaro": "pest", "shuka": "plant", "girbi": "harvest", "taki": "fertiliser", "abinci": "feed", "cin abinci": "eating", "kiwo": "grazing",
    "noma": "farming", "rube": "rot",
}
FIELD_NAMES = ("minor pest title", "minor pest description", "minor pest what to do.", "minor pest firstcontent", "minor pest position", "is this a minor pest?")
YORUBA_MARKS = "[ẹọṣẸỌṢ]"
YORUBA_MARKERS = (
    "ni", "mi", "mo", "ti", "won", "wọn", "ba", "bá", "ki", "kí", "se", "ṣe", "ohun", "kini", "kíni", "bawo", "báwo", "oko", "ewe", "ewé", "gbin",
    "ilẹ", "ile", "ọgbin", "eweko",
)
