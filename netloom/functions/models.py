"""Model names by the last arc of the system's object identifier."""


FORTINET_MODELS = {
    "30": "FortiGate VM64",
    "31": "FortiGate VM64VMX",
    "32": "FortiGate VM64SVM",
    "40": "FortiGate VM64XEN",
    "41": "fosVM64XEN",
    "45": "FortiGate VM64AWS",
    "46": "FortiGate VM64AWSONDEMAND",
    "47": "FortiGate VM64OPC",
    "60": "FortiGate VM64KVm",
    "65": "FortiGate VM64GCP",
    "70": "FortiGate VM64HV",
    "304": "FortiGate 30D",
    "305": "FortiGate 30DPOE",
    "306": "FortiGate 30E",
    "307": "FortiGate Rugged 30D",
    "308": "FortiGate Rugged 35D",
    "314": "fwf30D",
    "315": "fwf30DPOE",
    "316": "fwf30E",
    "320": "FortiGate 30EN",
    "321": "FortiGate 30EI",
    "322": "fw30EN",
    "323": "fw30EI",
    "505": "FortiGate 50E",
    "506": "fwf50E",
    "515": "FortiGate 51E",
    "516": "fwf51E",
    "517": "fw502R",
    "518": "FortiGate 52E",
    "624": "FortiGate 60D",
    "625": "FortiGate 60DPOE",
    "626": "fwf60D",
    "627": "fw60DP",
    "630": "FortiGate 90D",
    "631": "FortiGate 90DPOE",
    "632": "fwf90D",
    "633": "fwf90DPOE",
    "634": "FortiGate 94DPOE",
    "635": "FortiGate 98DPOE",
    "636": "FortiGate 92D",
    "637": "fwf92D",
    "638": "FortiGate Rugged 90D",
    "639": "fwf60E",
    "640": "FortiGate 61E",
    "641": "FortiGate 60E",
    "642": "FortiGate 60EPOE",
    "643": "FortiGate Rugged 60D",
    "649": "fwf61E",
    "661": "FortiGate 60EJ",
    "662": "fwf60EJ",
    "663": "FortiGate 60EV",
    "664": "fwf60EV",
    "700": "FortiGate 70D",
    "701": "FortiGate 70DPOE",
    "803": "FortiGate 80D",
    "841": "FortiGate 80EPOE",
    "842": "FortiGate 80E",
    "843": "FortiGate 81E",
    "844": "FortiGate 81EPOE",
    "900": "FortiGate 900D",
    "940": "FortiGate 90E",
    "941": "FortiGate 91E",
    "1004": "FortiGate 100D",
    "1005": "FortiGate 140E",
    "1006": "FortiGate 140EP",
    "1041": "FortiGate 100E",
    "1042": "FortiGate 100EF",
    "1043": "FortiGate 101E",
    "1401": "FortiGate 140D",
    "1402": "FortiGate 140P",
    "2005": "FortiGate 200D",
    "2006": "FortiGate 240D",
    "2007": "FortiGate 200DP",
    "2008": "FortiGate 240DP",
    "2009": "FortiGate 200E",
    "2010": "FortiGate 201E",
    "2013": "FortiGate 280D",
    "3006": "FortiGate 3HD",
    "3007": "FortiGate 300E",
    "3008": "FortiGate 301E",
    "4004": "FortiGate 400D",
    "4007": "FortiGate 400E",
    "4008": "FortiGate 401E",
    "5004": "FortiGate 500D",
    "5005": "FortiGate 500E",
    "5006": "FortiGate 501E",
    "6004": "FortiGate 600D",
    "6005": "FortiGate 600E",
    "6006": "FortiGate 601E",
    "8004": "FortiGate 800D",
    "10005": "FortiGate 1000D",
    "12000": "FortiGate 1200D",
    "15000": "FortiGate 1500D",
    "15001": "FortiGate 1500DT",
    "20000": "FortiGate 2000E",
    "25000": "FortiGate 2500E",
    "30000": "FortiGate 3000D",
    "31000": "FortiGate 3100D",
    "32000": "FortiGate 3200D",
    "34001": "FortiGate 3400E",
    "34011": "FortiGate 3401E",
    "36001": "FortiGate 3600E",
    "36011": "FortiGate 3601E",
    "37000": "FortiGate 3700D",
    "38001": "FortiGate 3800D",
    "38101": "FortiGate 3810D",
    "38150": "FortiGate 3815D",
    "39601": "FortiGate 3960E",
    "39801": "FortiGate 3980E",
    "50015": "FortiGate 5001D",
    "50016": "FortiGate 5001E",
    "50017": "FortiGate 5001E1",
    "90000": "fosVM64",
    "90010": "FortiGate VM64AZUREONDEMAND",
    "90018": "FortiGate VM64GCPONDEMAND",
    "90019": "FortiGate VM64ALI",
    "90020": "FortiGate VM64ALIONDEMAND",
    "90060": "fosVM64KVM",
    "90081": "FortiGate VM64AZURE",
}
