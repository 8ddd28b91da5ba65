"""Frozen thresholds of the diagnostic rules; fixed values. All are defaults of job parameters."""

ENGINE_ON_RPM = 50.0
SPEED_DENSITY = {
    "intercept": -14.688826051927967, "air_load": 0.023778032668470294, "map": 0.14127609145896305, "rpm": 6.690047685838753e-05, "iat": 0.07101467711912292,
    "clip_air_load": (293.93209175000004, 1516.36693525), "clip_map": (94.0, 203.0), "clip_rpm": (877.0, 2205.0), "clip_iat": (-8.0, 40.0),
}
PEDAL_MAP = {"slope": 0.997273, "intercept": 0.383103}
LIMITS = {
    "s1s2_high": 105.0, "s1s2_critical": 110.0, "s1s2_ambient": 25.0, "s1s3_rate": 0.5, "s1s3_level": 100.0, "s2s2_residual": -18.49488820957814,
    "s2s3b_rpm": 500.0, "s3s1a_slope": 2.4, "s3s1a_mask": 3, "s3s1a_low": -1.8350, "s3s1a_high": 1.3777, "s3s1b_delta": 65.0, "speed_std": 12.4,
    "maf_std": 8.5, "rpm_std": 241.0, "pedal_std": 9.9, "s4s1_stability": 0.1, "s4s3_low": -40.0, "s4s3_high": 215.0, "s5s2_rpm_slope": 9.0,
    "s5s2_mask": 10, "s5s2_low": -4.04, "s5s2_high": 16.71, "s5s3_flat": 0.0,
}
#: rule -> (kinds as (name, direction, seconds), opportunity, seconds of it, role, candidate code)
DURATION_RULES = {
    "1-S2": ((("high", "high", 180), ("critical", "high", 30)), "total_eligible", 180, "verdict", "P0217"),
    "1-S3": ((("precursor", "high", 180),), "run_meets", 360, "pending_precursor", None),
    "2-S2": ((("low", "low", 10),), "run_meets", 10, "verdict", "P0101"),
    "2-S3b": ((("zero_maf", "low", 10),), "run_meets", 10, "verdict", "P0102"),
    "3-S1a": ((("low", "low", 30), ("high", "high", 30)), "run_meets", 30, "verdict", "P2138"),
    "3-S1b": ((("extreme", "high", 2),), "run_meets", 2, "verdict", "P2138"),
    "4-S1": ((("flat", None, 120),), "run_meets_and_context", 240, "verdict", "P0111"),
    "5-S2": ((("low", "low", 30), ("high", "high", 30)), "run_meets", 30, "arbitration_evidence", None),
    "5-S3": ((("flat", None, 120),), "run_meets_and_context", 240, "verdict", "P0106"),
}
#: Why a rule without an opportunity was not evaluable; the other rules say no_qualifying_opportunity.
NO_OPPORTUNITY = {
    "1-S2": "insufficient_evaluable_time", "1-S3": "below_minimum_evaluable_window", "3-S1a": "no_qualifying_masked_opportunity", "4-S1": "no_context_opportunity",
    "5-S2": "outside_steady_domain", "5-S3": "no_context_opportunity",
}
#: The fault that the checks of each family belong to.
PROXIES = {
    "1": "cooling_degradation", "2": "air_intake_maf_anomaly", "3": "accelerator_pedal_sensor", "4": "intake_air_temperature_sensor_fault", "5": "map_load_signal_plausibility_fault",
}
PEDAL_STEPS = {"idle": 9.2, "steady_driving": 11.4, "acceleration": 18.6, "high_load": 26.5}
NO_RESPONSE = {"idle": (8.0, 4.0), "steady_driving": (None, 3.0), "acceleration": (4.0, 9.0), "high_load": (13.4, 1.0)}
CONDITIONS = {
    "rpm_on": 50.0, "ect_warm": 75.0, "air_mass_g": 1500.0, "iat_aat": 8.0, "hot_idle_rpm": 850.0, "moving_kmh": 1.0, "accel_band": 0.15,
    "high_load_vsp": 20.0, "high_load_accel": 1.2, "smooth": 3, "min_run": 3,
}
RISK_MEDIUM, RISK_HIGH = 0.4129, 0.9
TREND_TRIPS, TREND_HORIZON, TREND_CAP = 5, 10, 50
#: raw signal: physical low and high, suspicious low and high, how short gaps are filled
BOUNDS = {
    "coolant_temp": (-40.0, 215.0, -20.0, 125.0, "interpolation"), "map": (0.0, 255.0, 20.0, 250.0, "forward_fill"), "rpm": (0.0, 16383.75, 0.0, 7000.0, "forward_fill"),
    "speed": (0.0, 255.0, 0.0, 220.0, "interpolation"), "intake_temp": (-40.0, 215.0, -30.0, 100.0, "interpolation"), "maf": (0.0, 655.35, 0.0, 200.0, "interpolation"),
    "tps": (0.0, 100.0, 0.0, 100.0, "interpolation"), "ambient_temp": (-40.0, 215.0, -35.0, 55.0, "retain"), "accel_pedal_d": (0.0, 100.0, 0.0, 100.0, "interpolation"),
    "accel_pedal_e": (0.0, 100.0, 0.0, 100.0, "interpolation"),
}
#: Readings that stand for a broken sensor.
SENTINELS = {"intake_temp": (-40.0, 150.0)}
# Healthy range and unit of each signal that a window-risk record can name.
REFERENCE_RANGES = {
    "coolant_temp": (90.0, 95.0), "map": (36.0, 237.0), "maf": (0.0, 123.0), "tps": (0.0, 89.0), "rpm": (0.0, 3682.0), "speed": (0.0, 218.0),
    "accel_pedal_d": (0.0, 100.0), "accel_pedal_e": (0.0, 100.0), "accel_pedal_channel_delta": (0.0, 10.0), "ect_rate_180s": (0.0, 2.0),
    "intake_temp": (-3.0, 41.0), "ambient_temp": (-7.0, 25.0), "intake_ambient_delta": (0.0, 20.0), "speed_density_maf_residual": (-20.0, 20.0),
    "rpm_slope": (-120.0, 135.0), "pedal_mapping_residual": (-10.0, 10.0), "maf_integral_180s": (0.0, 2500.0), "intake_temp_stability": (0.0, 5.0),
    "map_range_60s": (0.0, 80.0), "pedal_slope": (-2.4, 2.4),
}
UNITS = {
    "coolant_temp": "°C", "map": "kPa", "maf": "g/s", "tps": "%", "rpm": "RPM", "speed": "km/h", "accel_pedal_d": "%", "accel_pedal_e": "%",
    "accel_pedal_channel_delta": "pp", "ect_rate_180s": "°C/min", "intake_temp": "°C", "ambient_temp": "°C", "intake_ambient_delta": "°C",
    "speed_density_maf_residual": "g/s", "rpm_slope": "RPM/s", "pedal_mapping_residual": "pp", "maf_integral_180s": "g", "intake_temp_stability": "°C",
    "map_range_60s": "kPa", "pedal_slope": "pp/s",
}
#: Signals that a record of each anomaly type names first.
PRIORITY_SIGNALS = {
    "cooling_degradation": ("coolant_temp", "ect_rate_180s", "maf_integral_180s"),
    "air_intake_maf_anomaly": ("maf", "map", "speed_density_maf_residual"),
    "accelerator_pedal_sensor": ("accel_pedal_d", "accel_pedal_e", "accel_pedal_channel_delta", "pedal_mapping_residual"),
    "intake_air_temperature_sensor_fault": ("intake_temp", "intake_temp_stability", "intake_ambient_delta", "ambient_temp", "coolant_temp"),
    "map_load_signal_plausibility_fault": ("map", "pedal_slope", "speed_density_maf_residual", "map_range_60s", "rpm_slope"),
}
