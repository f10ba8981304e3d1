r"""Word lists, patterns and thresholds that decide results.

Everything in this file is a fixed value.  Results are only right when these
equal the published rules of the directory, so they are stated plainly and in
their natural order.  ``\b`` in a pattern is an ASCII word edge; use
``functions.regex.java`` to hand a pattern to Spark.
"""

# --- cohort ---------------------------------------------------------------
PROGRAM_YEAR = "2026"
K5_AGE_RANGES = ["Grades K - 5", "Grades K - 12", "Ages 4+", "Ages 5 - 20"]
K5_GRADE_CODES = ["0K", "01", "02", "03", "04", "05"]
SCHEMA_VERSION = "2.6.0"
SCHOOL_RADIUS_M = 120
EARTH_M = 6371000.0
EARTH_MILES = 3958.8
RADIUS_MILES = 1.0
SPILLOVER_MILES = 2.0
NEAR_RADIUS_MILES = 3.0
CITY_BOX = (40.4, 41.0, -74.3, -73.6)

# --- organisation names ---------------------------------------------------
LEGAL_WORDS = r"\b(inc|incorporated|llc|ltd|l\.l\.c|corp|corporation)\b"
NAME_STOPWORDS = ["the", "of", "and", "for", "a", "an", "at"]
TRIMMABLE = [
    "center", "centre", "ctr", "community", "comm", "society", "services",
    "service", "association", "corporate", "foundation", "council", "program",
    "programs", "group", "nyc", "ny",
]
TOO_GENERIC = [
    "child", "children", "edge", "good", "new", "york", "city", "youth",
    "family", "center", "community", "police", "united", "greater", "grand",
    "university", "school", "public", "the", "harbor", "horizon",
]
DOMAIN_SUFFIXES = ["org", "com", "nyc"]

# --- page verification ----------------------------------------------------
PARKED_HOSTS = (
    r"(hugedomains|sedo|afternic|dan\.com|bodis|parkingcrew|domainmarket|"
    r"buydomains|undeveloped|namebright)"
)
PARKED_TEXT = (
    r"(this domain (name )?is for sale|buy this domain|domain for sale|"
    r"inquire about this domain|the domain .{0,40} is for sale)"
)
WEAK_SIGNALS = [
    "brooklyn", "queens", "bronx", "manhattan", "staten", "island", "york",
    "city", "women", "young", "north", "south", "east", "west", "homes",
    "housing", "team", "door", "children", "child", "youth", "family",
    "development", "neighborhood", "council", "club", "boys", "girls",
    "health", "human", "social", "school", "academy", "jewish", "christian",
    "association", "institute", "house", "dance", "theatre", "arts", "center",
    "community", "services", "outreach", "initiatives", "corporation", "public",
]
REGION_MARKERS = (
    r"\b(new york|nyc|brooklyn|bronx|queens|manhattan|staten island|harlem|"
    r"n\.y\.|ny 1[0-1]\d{3})\b"
)
SHORT_PAGE_CHARS = 400

# --- links and images on a page -------------------------------------------
INTERESTING_LINK = (
    r"(after[-\s]?school|program|youth|kids|children|stem|steam|robotic|maker|"
    r"technology|coding|science|summer|camp|gallery|photos|our-work|what-we-do|"
    r"services|activities)"
)
SKIP_LINK = (
    r"(donate|privacy|terms|login|careers|jobs|press|news\/|blog\/|event|"
    r"calendar|contact|volunteer|board|annual-report|\.pdf|\.docx?|mailto:|tel:)"
)
PAGES_PER_PROVIDER = 6
IMAGES_PER_PROVIDER = 12
IMAGES_AT_CRAWL = 48
IMAGE_SHORTLIST = 36
ALT_CHARS = 240
REJECT_IMAGE_NAME = (
    r"(logo|icon|favicon|sprite|avatar|placeholder|banner-ad|pixel|spacer|badge|"
    r"button|arrow|bullet|footer|header-bg|1x1|blank)"
)
IMAGE_MIN_WIDTH, IMAGE_MIN_HEIGHT = 400, 300
IMAGE_MAX_SIDE, IMAGE_MAX_PIXELS, IMAGE_MAX_BYTES = 4000, 12_000_000, 8_000_000
CAROUSEL_MIN_HEIGHT, CAROUSEL_MIN_ASPECT = 600, 1.0
KEPT_KINDS = ["program-photo", "flyer"]
REJECT_FUNNEL = [
    "similar-photo", "resized-copy", "duplicate-file", "text-only", "logo",
    "stock", "other", "unclassified", "over-limit", "too-small", "too-large",
    "too-many-pixels", "too-heavy", "aspect", "mime", "unparseable",
    "download-failed", "robots", "filename", "shortlist-full", "unrecorded",
]

# --- vocabulary of tools and subjects -------------------------------------
TOOL_VOCAB = [
    "3d printing", "robotics", "lego", "micro:bit", "arduino", "raspberry pi",
    "coding", "web development", "game design", "laser cutter", "woodworking",
    "sewing/textiles", "electronics", "circuitry", "drones", "chess",
    "science lab", "gardening", "cooking", "digital art", "video production",
    "music production", "animation", "math enrichment", "engineering",
]
SUBJECT_GROUPS = {
    "Science": [
        "biology", "chemistry", "physics", "earth & environmental science",
        "general science", "gardening",
    ],
    "Technology": [
        "computer science", "coding", "robotics", "game design", "electronics",
        "3d design & printing", "technology & digital media",
    ],
    "Engineering": ["engineering", "maker & building"],
    "Math & strategy": ["mathematics", "chess", "financial literacy"],
    "Arts": [
        "visual arts", "music", "dance & theater", "animation",
        "filmmaking & video", "crafts & sewing",
    ],
    "Literacy & languages": ["literacy & writing", "languages", "social studies"],
    "Health & movement": ["sports & fitness", "health & nutrition", "cooking"],
    "Social-emotional": ["leadership & social-emotional"],
}
SUBJECT_VOCAB = [s for group in SUBJECT_GROUPS.values() for s in group]
TOOL_PATTERNS = {
    "robotics": r"\brobot(ic)?s?\b|\bvex\b|\bfirst lego league\b",
    "lego": r"\blego\b",
    "coding": r"\bcoding\b|\blearn(ing)? to code\b|\bscratch (jr|junior|programming)\b|\bpython\b|\bcomputer programming\b",
    "3d printing": r"\b3-?d print",
    "electronics": r"\belectronics\b|\bcircuits?\b|\bcircuitry\b|\bsoldering\b",
    "micro:bit": r"micro:?bit",
    "arduino": r"\barduino\b",
    "raspberry pi": r"raspberry pi",
    "science lab": r"\bscience (lab|club|experiments?)\b|\bhands-on science\b",
    "engineering": r"\bengineering\b",
    "digital art": r"\bdigital (art|media)\b|\bgraphic design\b",
    "video production": r"\bvideo production\b|\bfilmmaking\b",
    "game design": r"\b(video )?game design\b",
    "chess": r"\bchess\b",
    "gardening": r"\bgardening\b|\b(community|school|urban|rooftop|teaching) garden\b",
    "math enrichment": r"\bmath (enrichment|tutoring|club|games)\b",
    "cooking": r"\bcooking (class|club|program|lesson)s?\b|\bculinary\b",
    "animation": r"\banimation\b",
}
SUBJECT_PATTERNS = {
    "biology": r"\bbiology\b|\blife sciences?\b|\bmarine science\b|\bzoology\b",
    "chemistry": r"\bchemistry\b",
    "physics": r"\bphysics\b",
    "earth & environmental science": r"\benvironmental (science|education|stewardship)\b|\bearth science\b|\bclimate science\b|\becology\b",
    "general science": r"\bscience (club|lab|experiments?|enrichment|class(es)?|activities)\b|\bhands-on science\b",
    "gardening": TOOL_PATTERNS["gardening"],
    "computer science": r"\bcomputer science\b|\bcomputer (skills|literacy|lab|class(es)?)\b",
    "coding": TOOL_PATTERNS["coding"],
    "robotics": TOOL_PATTERNS["robotics"],
    "game design": TOOL_PATTERNS["game design"],
    "electronics": TOOL_PATTERNS["electronics"],
    "3d design & printing": r"\b3-?d (print|design|model)",
    "technology & digital media": r"\bdigital (media|literacy)\b|\bmedia (arts|literacy)\b|\btechnology (class|workshop|program|lab)s?\b",
    "engineering": TOOL_PATTERNS["engineering"],
    "maker & building": r"\bmaker ?space\b|\bmaker (lab|club|projects?)\b|\blego\b|\bwoodworking\b",
    "mathematics": r"\bmathematics\b|\bmath (enrichment|tutoring|club|games|skills|help|support)\b",
    "chess": TOOL_PATTERNS["chess"],
    "financial literacy": r"\bfinancial literacy\b|\bmoney management\b",
    "visual arts": r"\bvisual arts?\b|\bpainting\b|\bdrawing\b|\bmurals?\b",
    "music": r"\bmusic (class|lesson|program|production|education)s?\b|\bchoir\b|\bchorus\b|\bdrumming\b|\bpiano\b|\bguitar\b|\bviolin\b",
    "dance & theater": r"\bdance (class|lesson|program|team)s?\b|\btheat(er|re) (arts|class|program)s?\b|\bdrama\b|\bstep team\b",
    "animation": TOOL_PATTERNS["animation"],
    "filmmaking & video": r"\bfilmmaking\b|\bvideo production\b|\bfilm (club|making|program)\b",
    "crafts & sewing": r"\barts (and|&|&amp;) crafts\b|\bsewing\b|\bknitting\b",
    "literacy & writing": r"(?<!(financial|digital|media|computer) )\bliteracy\b|\bcreative writing\b|\bbook clubs?\b|\breading (club|program|skills)\b",
    "languages": r"\bforeign languages?\b|\b(spanish|mandarin|chinese|french|arabic) (class|lesson)s?\b",
    "social studies": r"\bsocial studies\b|\bcivics\b",
    "sports & fitness": r"\bsports\b|\bfitness\b|\bbasketball\b|\bsoccer\b|\bswimming\b|\bmartial arts\b|\byoga\b",
    "health & nutrition": r"\bnutrition\b|\bhealthy (eating|habits)\b",
    "cooking": TOOL_PATTERNS["cooking"],
    "leadership & social-emotional": r"\bsocial[- ]emotional\b|\bleadership (development|skills|training)\b|\bcharacter (development|building|education)\b",
}
NOT_ABOUT_KIDS = (
    r"\b(adults?|seniors?|older adults|elderly|residents?|staff|group fitness|esl|"
    r"english for speakers|english language learners|citizenship|high school "
    r"equivalency|hse|ged|snap|benefits|job|jobs|workforce|employment|career|"
    r"careers|apprenticeships?|therapy|therapists?|patients?|tenants|legal|"
    r"lifeguards?|certification|caregivers|health insurance|medicaid)\b"
)
HAS_PROGRAM = r"\b(elementary|grades? k|kindergarten|after[-\s]?school)\b"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE = r"\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}"
QUOTE_REACH = 90
QUOTE_MIN_CHARS = 8
CORPUS_CHARS = 60000
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "ndash": "-",
    "mdash": "-", "hellip": "...", "bull": " ", "raquo": " ", "laquo": " ",
}

# --- cost and provenance --------------------------------------------------
FREE_AREA = "Compass"
COST_RULE_URL = (
    "https://www.nyc.gov/site/dycd/services/after-school/"
    "comprehensive-after-school-system-of-new-york-city-compass.page"
)
COST_RULE_NOTE = f'DYCD: COMPASS programs are "offered at no cost to youth" ({COST_RULE_URL}).'
COST_TIERS = ["free", "sliding-scale", "paid", "unknown"]
COST_SOURCES = ["dycd-program-rules", "provider-website", "not-published"]
MODEL_METHOD = "gemini"
KEYWORD_METHOD = "keyword"
CORE_SOURCE = "nyc-opendata:ebkm-iyma"
SCHOOL_SOURCE = f"nyc-opendata:wg9x-4ke6 (<={SCHOOL_RADIUS_M}m, K-5 preferred)"
SIGNUP_PORTAL = "https://discoverdycd.dycdconnect.nyc/"

# --- cards ----------------------------------------------------------------
TOOLS_THAT_ARE_SUBJECTS = [
    "coding", "robotics", "engineering", "electronics", "chess", "gardening",
    "cooking", "game design", "animation",
]
LABELS = {
    "3d printing": "3D printing", "micro:bit": "micro:bit", "lego": "LEGO",
    "raspberry pi": "Raspberry Pi", "arduino": "Arduino",
}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]
WEEK = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
SUBJECT_KEYS = {
    "robotics": ["robotics"],
    "coding": ["coding", "computer science", "game design", "technology & digital media"],
    "chess": ["chess"],
    "engineering": ["engineering", "maker & building", "electronics", "3d design & printing"],
    "science": ["biology", "chemistry", "physics", "general science", "earth & environmental science"],
    "gardening": ["gardening"],
    "math": ["mathematics", "financial literacy"],
    "cooking": ["cooking"],
    "art": ["visual arts", "crafts & sewing", "animation", "filmmaking & video"],
    "music": ["music"],
    "dance": ["dance & theater"],
    "reading": ["literacy & writing", "languages", "social studies"],
    "sports": ["sports & fitness", "health & nutrition"],
}
ABOUT_KIDS = (
    r"\b(kids?|child|children|students?|youth|camp|after ?school|compass|sonyc|"
    r"classroom|stem|steam|robot(ics)?|chess|lego|art|painting|science|gardening|"
    r"summer|elementary|play(ing)?|learn(ing)?)\b"
)
ADULT_OR_FUNDRAISING = (
    r"\b(seniors?|older|elderly|adults?|staff|board|gala|donate|donation|"
    r"homeless(ness)?|housing|clinic|health|food|pantry|ceo|director|volunteers?|"
    r"jobs?|careers?|workforce|employment|tenants?|rent|legal|immigration|"
    r"scholarship|podcast|justice|rally)\b"
)
GRAPHIC = (
    r"logo|icon|circle|bubble|ellipse|shape|blob|wave|pattern|texture|background|"
    r"\bbg\b|vector|illustration|graphic|placeholder|badge|avatar|sprite|arrow|"
    r"divider|overlay|mockup|screenshot|rectangle|button|\bcta\b|\bmap\b|quote|"
    r"flyer|howtoapply|register|enroll|give|\bgroup[-_ ]?\d+|linkedin|youtube|"
    r"facebook|instagram|twitter|tiktok|newsletter|save[-_+ ]?the[-_+ ]?date|"
    r"\bstd\b|campaign|category|popup|signup|contact|emptystate|slider[-_ ]?art|"
    r"social[-_+ ]?post"
)
TILES = 3

# --- media pool -----------------------------------------------------------
OK_LICENSE = r"^(CC BY(-SA)? [\d.]+|CC0|Public domain)"
NOT_A_PHOTO = (
    r"\b(1[0-8]\d\d|19[0-6]\d)\b|painting|oil on|engraving|lithograph|drawing by|"
    r"NARA|Library of Congress|\bLOC\b|postcard|poster|map of|logo|diagram|\.tif"
)
MILITARY = (
    r"\b(army|navy|naval|marines?|marine corps|usmc|air ?force|airm[ae]n|soldiers?|"
    r"sailors?|seabees?|military|dodea|dod|defen[cs]e|corps of engineers|cerdec|"
    r"national guard|troops?|petty officer|sgt|spc|cpl|pfc|seaman|veterans?|base|"
    r"garrison|fort [a-z]+|mwr|morale,? welfare|uso|coast guard|orphanage|war|"
    r"refugees?)\b|\b\d{6}-[A-Z]-[A-Z0-9]{2,6}-\d{2,4}\b|US_Navy|USMC-|USAF"
)
MEDIA_MIN_WIDTH, MEDIA_MIN_ASPECT, MEDIA_MAX_ASPECT = 1000, 1.2, 2.2
MEDIA_TARGETS = {
    "robotics": 150, "coding": 70, "chess": 50, "engineering": 90, "science": 105,
    "gardening": 20, "math": 70, "cooking": 100, "art": 30, "music": 15,
    "dance": 15, "reading": 105, "sports": 180, "default": 480,
}

# --- questions ------------------------------------------------------------
RESULT_LIMIT = 8
NAMED_LIMIT = 12
TOPIC_PATTERNS = {
    "coding": r"\b(cod(e|ing)|programming|scratch|python|computer science)\b",
    "robotics": r"\brobots?\b|\brobotics\b",
    "math": r"\bmath\b|\bmathematics\b|\balgebra\b|\bgeometry\b",
    "science": r"\bscience\b|\bbiology\b|\bchemistry\b|\bphysics\b",
    "engineering": r"\bengineering\b|\bmakers?\b|\bbuilding\b",
    "chess": r"\bchess\b",
    "cooking": r"\bcooking\b|\bculinary\b",
    "sports": r"\bsports?\b|\bfitness\b",
    "art": r"\bart\b|\barts\b|\bcrafts?\b",
    "music": r"\bmusic\b",
    "dance": r"\bdance\b|\btheater\b|\btheatre\b",
    "animation": r"\banimation\b|\banimated\b",
    "gardening": r"\bgarden(ing)?\b",
    "literacy": r"\bliteracy\b|\bwriting\b|\breading\b",
    "electronics": r"\belectronics?\b|\bcircuits?\b|\bsoldering\b",
    "lego": r"\blego\b|\bduplo\b",
    "video production": r"\bvideo\b|\bfilm(making)?\b|\bmovies?\b",
    "digital art": r"\bdigital art\b|\bdigital media\b|\bgraphic design\b",
    "sewing": r"\bsewing\b|\bknitting\b|\bstitching\b",
    "nutrition": r"\bnutrition\b|\bhealthy eating\b",
    "leadership": r"\bleadership\b|\bsocial[- ]emotional\b",
    "languages": r"\blanguages?\b|\bspanish\b|\bbilingual\b|\bmandarin\b",
    "3d printing": r"\b3-?d\s*(print(ing|er)?|design)\b",
}
# A topic also matches a row whose topics, joined by blanks, match this.
TOPIC_ROW_PATTERNS = {
    "art": r"\bart|craft",
    "sports": r"\bsport|fitness",
    "science": r"\bscience|biology|chemistry|physics",
    "math": r"\bmath",
    "coding": r"\bcod|computer science|programming",
}
BOROUGH_ALIASES = {
    "staten island": ["staten island", "si"],
    "brooklyn": ["brooklyn", "bk"],
    "manhattan": ["manhattan"],
    "queens": ["queens"],
    "bronx": ["bronx"],
}
PLACE_SKIP = [
    "the", "a", "at", "of", "and", "center", "community", "school", "middle",
    "youth", "space", "maker", "new", "york", "city", "north", "south", "east",
    "west",
]
QUESTION_STOPWORDS = [
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "with",
    "me", "my", "our", "you", "your", "is", "are", "do", "does", "can", "what",
    "which", "where", "when", "who", "how", "any", "some", "there", "have", "has",
    "program", "programs", "project", "projects", "class", "classes", "stem",
    "open", "available", "one", "ones", "that", "this", "show", "find", "list",
    "looking", "want", "need", "about", "please", "good", "best", "website",
    "site", "kid", "kids", "child", "children", "parent", "parents", "tell",
    "more", "dycd", "afterschool", "workshop", "workshops", "nyc", "near",
]
FAQ_PHRASES = {
    "about": [
        "what is this website", "what is this site", "whats this site",
        "about the website", "about this site", "what is this about",
    ],
    "sign-up": [
        "how do i sign up", "how to sign up", "how do we sign up", "how to register",
        "how do i register", "how to enroll", "how do i enroll",
    ],
    "contact": [
        "how do i contact", "contact you", "email you", "phone number",
        "who do i talk to",
    ],
    "safety": [
        "is it safe", "are they safe", "is this safe", "safety",
        "are these programs safe", "background check", "are the staff vetted",
        "is my child safe",
    ],
}
# Fixed answer texts; {site} is what the directory calls itself, {total} its number of programs.
ANSWERS = {
    "empty": "Ask me about programs — what time they meet, whether they're free, who they're for, or where they are.",
    "greeting": "Hi! I can help you find programs on {site}. Ask about a borough, ZIP, cost, age, or topic — for example, “free robotics in Brooklyn.”",
    "help": "I can look up NYC programs by borough, ZIP, neighborhood, cost, age, and topic. Try “Which programs are free?”, “robotics in Brooklyn”, or “What's good for a 7 year old in 11213?” Clock times are only used when the city published them — I will not invent hours or prices.",
    "unknown-zip": "I don't know ZIP {zip}, so I can't measure distance from it. Try a borough or a neighbourhood instead.",
    "overview": "{Site} lists {total} K–5 programs across Brooklyn, the Bronx, Queens, Manhattan, and Staten Island. Ask for a borough, neighborhood, or ZIP — for example, “programs in Brooklyn” or “11213”.",
    "keyword": "These are the closest matches I have:",
    "none": "I can only answer from the program list of {site}, and I didn't find a match for that. Ask about free COMPASS programs, a borough or ZIP, ages, or topics like robotics or coding.",
}
FAQ_ANSWERS = {
    "about": "{Site} lists K–5 STEM after-school programs in New York City. Names, addresses, ages, and seats come from NYC OpenData. Cost is marked Free only for DYCD COMPASS programs; Beacon and Cornerstone fees are not published, so those say Ask provider.",
    "sign-up": "{Site} does not take sign-ups. Each program card links to the provider's website when we have it, otherwise to DiscoverDYCD (https://discoverdycd.dycdconnect.nyc/). Ask for a program by name if you want that link.",
    "contact": "Contact the program provider. Ask for a program by name and I can point you to its sign-up page. City enrollment also runs through DiscoverDYCD.",
    "safety": "{Site} does not inspect or vet programs, so I can't vouch for any of them. Every program listed holds a DYCD contract with New York City, which carries the city's own requirements, and DYCD publishes evaluation reports for program sites. For anything specific — staffing, ratios, background checks — ask the provider directly; each program card links to them.",
}

# --- requests, calls, fetches ---------------------------------------------
RATE_MAX = 12
RATE_WINDOW_S = 60
CALL_BUDGET = 2000
CALLS_PER_MINUTE = 12
HOST_DELAY_MS = 1000
MIN_PAGE_TEXT = 200
