"""Column names and response texts shared by all operators."""

POS = "_pos"

# Statuses and texts that callers match on.
OK, MISSING, NOT_FOUND, INVALID = 200, 400, 404, 422

MSG_DEFAULT_OK = "successs"
MSG_DEFAULT_ERROR = "an error occurred"
MSG_INVALID_PAYLOAD = "invalid payload format"
MSG_NEED_COUNTRY = "missing param (country)"
MSG_NEED_STATE = "missing param (state)"
MSG_NEED_CITY = "missing param (city)"
MSG_NEED_COUNTRY_OR_ISO2 = "missing param (country or iso2)"
MSG_NEED_COUNTRY_OR_ISO3 = "missing param (country or iso3)"
MSG_NEED_RANGE = "missing param (type, min, max)"
MSG_NEED_RETURNS = "you must specify data to fetch e.g ?returns=unicodeFlag,currency,image"
MSG_NO_COUNTRY = "country not found"
MSG_NO_COUNTRY_POSITION = "Country not found"
MSG_NO_STATE = "state not found"
MSG_NO_COUNTRY_DATA = "country data not found"
MSG_NO_CITY_DATA = "city data not found"
MSG_DIAL_CODE = "{answer.name} dial code retrieved"
MSG_POSITION = "country position retrieved"
MSG_CURRENCY = "{answer.name} and currency retrieved"
MSG_ISO = "country's ISO code retrieved"
MSG_CAPITAL = "country and capitals retrieved"
MSG_FLAG = "{answer.name} and flag retrieved"
MSG_UNICODE_FLAG = "{answer.name} and unicode flag retrieved"
MSG_STATES = "states in {answer.name} retrieved"
MSG_COUNTRY_POPULATION = "{answer.country} with population"
MSG_CITY_POPULATION = "{request.city} with population"
MSG_CITIES = "cities in {answer.country} retrieved"
MSG_STATE_CITIES = "cities in state {request.state} of country {request.country} retrieved"
