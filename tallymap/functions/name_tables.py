"""Lookup tables for region names.  FIXED VALUES: results depend on the entries
and, for the containment rule, on the order of the aliases."""

UNKNOWN = "Unknown"

# Fixed values: (spelling in lower case, official name), 28 states, 8 union territories,
# then frequent misspellings.
ALIASES: tuple[tuple[str, str], ...] = (
    ("andhra pradesh", "Andhra Pradesh"),
    ("arunachal pradesh", "Arunachal Pradesh"),
    ("assam", "Assam"),
    ("bihar", "Bihar"),
    ("chhattisgarh", "Chhattisgarh"),
    ("goa", "Goa"),
    ("gujarat", "Gujarat"),
    ("haryana", "Haryana"),
    ("himachal pradesh", "Himachal Pradesh"),
    ("jharkhand", "Jharkhand"),
    ("karnataka", "Karnataka"),
    ("kerala", "Kerala"),
    ("madhya pradesh", "Madhya Pradesh"),
    ("maharashtra", "Maharashtra"),
    ("manipur", "Manipur"),
    ("meghalaya", "Meghalaya"),
    ("mizoram", "Mizoram"),
    ("nagaland", "Nagaland"),
    ("odisha", "Odisha"),
    ("punjab", "Punjab"),
    ("rajasthan", "Rajasthan"),
    ("sikkim", "Sikkim"),
    ("tamil nadu", "Tamil Nadu"),
    ("telangana", "Telangana"),
    ("tripura", "Tripura"),
    ("uttar pradesh", "Uttar Pradesh"),
    ("uttarakhand", "Uttarakhand"),
    ("west bengal", "West Bengal"),
    ("andaman and nicobar islands", "Andaman & Nicobar Islands"),
    ("andaman & nicobar islands", "Andaman & Nicobar Islands"),
    ("chandigarh", "Chandigarh"),
    ("dadra and nagar haveli and daman and diu", "Dadra & Nagar Haveli and Daman & Diu"),
    ("dadra & nagar haveli and daman & diu", "Dadra & Nagar Haveli and Daman & Diu"),
    ("dadra and nagar haveli", "Dadra & Nagar Haveli and Daman & Diu"),
    ("daman and diu", "Dadra & Nagar Haveli and Daman & Diu"),
    ("delhi", "Delhi"),
    ("nct of delhi", "Delhi"),
    ("national capital territory of delhi", "Delhi"),
    ("jammu and kashmir", "Jammu & Kashmir"),
    ("jammu & kashmir", "Jammu & Kashmir"),
    ("ladakh", "Ladakh"),
    ("lakshadweep", "Lakshadweep"),
    ("puducherry", "Puducherry"),
    ("pondicherry", "Puducherry"),
    ("west bangal", "West Bengal"),
    ("west bengli", "West Bengal"),
    ("westbengal", "West Bengal"),
    ("orissa", "Odisha"),
    ("uttaranchal", "Uttarakhand"),
    ("chhatisgarh", "Chhattisgarh"),
    ("chattisgarh", "Chhattisgarh"),
    ("andhrapradesh", "Andhra Pradesh"),
    ("arunachalpradesh", "Arunachal Pradesh"),
    ("himachalpradesh", "Himachal Pradesh"),
    ("madhyapradesh", "Madhya Pradesh"),
    ("tamilnadu", "Tamil Nadu"),
    ("uttarpradesh", "Uttar Pradesh"),
    ("andaman nicobar", "Andaman & Nicobar Islands"),
    ("a&n islands", "Andaman & Nicobar Islands"),
    ("d&nh", "Dadra & Nagar Haveli and Daman & Diu"),
    ("dnh", "Dadra & Nagar Haveli and Daman & Diu"),
    ("j&k", "Jammu & Kashmir"),
)

# Entries of the state column that are cities or numbers.
INVALID_NAMES: tuple[str, ...] = (
    "100000", "jaipur", "nagpur", "darbhanga", "balanagar", "madanapalle",
    "raja annamalai puram", "puttenahalli", "mumbai", "bangalore", "hyderabad",
    "chennai", "kolkata", "ahmedabad", "surat", "pune", "indore", "kanpur",
    "lucknow", "thane", "bhopal", "visakhapatnam", "patna", "vadodara", "ghaziabad",
    "ludhiana", "agra", "nashik", "faridabad", "meerut", "rajkot", "kalyan-dombivli",
    "vasai-virar", "varanasi", "srinagar", "aurangabad", "dhanbad", "amritsar",
    "navi mumbai", "allahabad", "ranchi", "howrah", "coimbatore", "jabalpur",
    "gwalior", "vijayawada", "jodhpur", "madurai", "raipur", "kota",
)
