"""Scales, units, cities and vocabularies."""

# Published scales, unit factors, boxes and vocabularies that results must agree with.
DEFAULT_SCALE = "naqi"
POLLUTANTS = ("pm25", "pm10", "o3", "no2", "so2", "co")
TARGET_POLLUTANTS = ("pm25", "pm10", "no2", "so2")
SOURCES = ("user", "openaq", "simulated", "government")
UG, MG = "µg/m³", "mg/m³"
PPB_TO_UG = {"no2": 1.88, "so2": 2.62, "o3": 1.96}
PPM_TO_MG = {"co": 1.145}
CITIES = (
    ("Delhi NCR", 28.40, 76.80, 28.90, 77.50),
    ("Mumbai", 18.85, 72.75, 19.30, 73.05),
    ("Bangalore", 12.80, 77.40, 13.15, 77.80),
)
CATEGORIES = {
    "naqi": (
        ("Good", "#00b050", 0, 50), ("Satisfactory", "#92d050", 51, 100), ("Moderate", "#ffff00", 101, 200),
        ("Poor", "#ff7e00", 201, 300), ("Very Poor", "#ff0000", 301, 400), ("Severe", "#7e0023", 401, 1000),
    ),
    "epa": (
        ("Good", "#00e400", 0, 50), ("Moderate", "#ffff00", 51, 100), ("Unhealthy for Sensitive Groups", "#ff7e00", 101, 150),
        ("Unhealthy", "#ff0000", 151, 200), ("Very Unhealthy", "#8f3f97", 201, 300), ("Hazardous", "#7e0023", 301, 1000),
    ),
}
DARK = {"naqi": ("Poor", "Very Poor", "Severe"), "epa": ("Unhealthy", "Very Unhealthy", "Hazardous")}
#: Bands of each scale and pollutant, in order: low and high concentration, low and high index.
BANDS = {
    "naqi": {
        "pm25": ((0, 30, 0, 50), (30, 60, 51, 100), (60, 90, 101, 200), (90, 120, 201, 300), (120, 250, 301, 400), (250, 500, 401, 500)),
        "pm10": ((0, 50, 0, 50), (50, 100, 51, 100), (100, 250, 101, 200), (250, 350, 201, 300), (350, 430, 301, 400), (430, 1000, 401, 500)),
        "o3": ((0, 50, 0, 50), (50, 100, 51, 100), (100, 168, 101, 200), (168, 208, 201, 300), (208, 748, 301, 400), (748, 2000, 401, 500)),
        "no2": ((0, 40, 0, 50), (40, 80, 51, 100), (80, 180, 101, 200), (180, 280, 201, 300), (280, 400, 301, 400), (400, 1000, 401, 500)),
        "so2": ((0, 40, 0, 50), (40, 80, 51, 100), (80, 380, 101, 200), (380, 800, 201, 300), (800, 1600, 301, 400), (1600, 3000, 401, 500)),
        "co": ((0, 1, 0, 50), (1, 2, 51, 100), (2, 10, 101, 200), (10, 17, 201, 300), (17, 34, 301, 400), (34, 100, 401, 500)),
    },
    "epa": {
        "pm25": ((0, 9, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 500.4, 301, 500)),
        "pm10": ((0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150), (255, 354, 151, 200), (355, 424, 201, 300), (425, 604, 301, 500)),
        "o3": ((0, 108, 0, 50), (108, 140, 51, 100), (140, 170, 101, 150), (170, 210, 151, 200), (210, 400, 201, 300), (400, 1200, 301, 500)),
        "no2": ((0, 100, 0, 50), (100, 188, 51, 100), (188, 677, 101, 150), (677, 1221, 151, 200), (1221, 2349, 201, 300), (2349, 3853, 301, 500)),
        "so2": ((0, 92, 0, 50), (92, 196, 51, 100), (196, 485, 101, 150), (485, 796, 151, 200), (796, 1583, 201, 300), (1583, 2631, 301, 500)),
        "co": ((0, 5.1, 0, 50), (5.1, 10.8, 51, 100), (10.8, 14.3, 101, 150), (14.3, 17.7, 151, 200), (17.7, 34.9, 201, 300), (34.9, 57.9, 301, 500)),
    },
}
#: Older bands of the two fine-particle scales, for comparing scales: (low, high, index low, index high).
COMPARED = {
    "epa": ((0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300), (250.5, 500.4, 301, 500)),
    "naqi": ((0, 30, 0, 50), (31, 60, 51, 100), (61, 90, 101, 200), (91, 120, 201, 300), (121, 250, 301, 400), (251, 500, 401, 500)),
}
MAX_INDEX = 1000
SOURCE_LABELS = {"user": "User Entries", "openaq": "OpenAQ", "government": "Government", "simulated": "Simulated"}
SCALE_LABELS = {"naqi": "India NAQI", "epa": "US EPA"}
POLLUTANT_LABELS = {"pm25": "PM2.5", "pm10": "PM10", "o3": "Ozone (O₃)", "no2": "Nitrogen Dioxide (NO₂)", "so2": "Sulphur Dioxide (SO₂)", "co": "Carbon Monoxide (CO)"}


def bands(scale: str, pollutant: str) -> list[tuple[float, float, int, int]]:
    """A pollutant's bands on a scale, in order: low and high concentration, low and high index."""
    return [(float(a), float(b), i, j) for a, b, i, j in BANDS[scale][pollutant]]
