"""Masses in Da, and the vocabulary in its order (ids follow from it, after PAD and SOS)."""

PAD, SOS = 0, 1
RESIDUES = {
    "G": 57.021463735, "A": 71.037113805, "S": 87.032028435, "P": 97.052763875, "V": 99.068413945, "T": 101.047678505, "C+57.021": 103.009184505 + 57.02146,
    "L": 113.084064015, "I": 113.084064015, "N": 114.042927470, "D": 115.026943065, "Q": 128.058577540, "K": 128.094963050, "E": 129.042593135, "M": 131.040484645,
    "H": 137.058911875, "F": 147.068413945, "R": 156.101111050, "Y": 163.063328575, "W": 186.079312980,
    "+42.011": 42.010565, "+43.006": 43.005814, "-17.027": -17.026549, "+43.006-17.027": 43.006814 - 17.026549,
    "M+15.995": 131.040484645 + 15.994915, "N+0.984": 114.042927470 + 0.984016, "Q+0.984": 128.058577540 + 0.984016,
}
H, O, N = 1.007825035, 15.99491463, 14.003074
H2O, NH3 = 2 * H + O, 3 * H + N
PROTON, ISOTOPE = 1.00727646688, 1.00335
PTMS = ("C+57.021", "M+15.995", "N+0.984", "Q+0.984", "+42.011", "+43.006", "-17.027", "+43.006-17.027")
